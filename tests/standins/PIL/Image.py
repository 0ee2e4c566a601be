import enum

import numpy as np


class Resampling(enum.Enum):
    BICUBIC = 3
    LANCZOS = 1


class Picture:
    size = (1000, 1000)
    width = height = 1000

    def __init__(self, content):
        self.content = content

    def _same(self, *_, **__):
        return self

    convert = crop = resize = filter = enhance = _same

    def save(self, out, format):  # noqa: A002
        out.write(self.content)

    def __array__(self, dtype=None, copy=None):
        return np.frombuffer(self.content, np.uint8)


def open(file):  # noqa: A001
    return Picture(file.read())

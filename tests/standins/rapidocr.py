"""A stand-in for the neural reader: a picture's content says what is read."""

import json
import types


class RapidOCR:
    def __call__(self, image):
        return types.SimpleNamespace(txts=json.loads(bytes(image)))

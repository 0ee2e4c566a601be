"""A stand-in for the PDF library: a packet is JSON, and what is done with it is written to its log."""

import builtins
import json
import os
import types

csRGB = "rgb"  # noqa: N816


class Page:
    def __init__(self, packet, number, said):
        self._packet, self._number, self._said = packet, number, said
        self.rect = types.SimpleNamespace(width=600.0, height=800.0)

    def get_text(self, form="text"):
        if self._said.get("broken"):
            raise ValueError("broken page")
        lines = self._said.get("text", [])
        if form != "dict":
            return "\n".join(lines)
        runs = [{"text": t, "bbox": (10, 20 * i, 200, 20 * i + 10), "size": 10, "color": 0} for i, t in enumerate(lines, 1)]
        return {"blocks": [{"lines": [{"spans": runs}]}]}

    def get_images(self, full=True):
        return [((self._number, k), 0, *image[:2]) for k, image in enumerate(self._said.get("images", []))]

    def get_pixmap(self, dpi, alpha):
        self._packet.note(f"draw {self._number} {dpi}")
        if self._said.get("undrawable"):
            raise ValueError("can't be drawn")
        return types.SimpleNamespace(tobytes=lambda form: json.dumps(self._said.get("ink", [])).encode())


class Document:
    def __init__(self, content):
        self._said = json.loads(content)
        self.note("open")
        self._pages = self._said.get("pages") or [{"text": [self._said["text"]]}] * self._said["n"]

    def note(self, what):
        with builtins.open(self._said["log"], "a") as file:
            file.write(f"{self._said['name']} {os.getpid()} {what}\n")

    def __len__(self):
        return len(self._pages)

    def __getitem__(self, i):
        return Page(self, i + 1, self._pages[i])

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def close(self):
        pass


class Pixmap:
    def __init__(self, document, image):
        page, k = image
        document.note(f"decode {page} {k}")
        self.width, self.height, lines = document._said["pages"][page - 1]["images"][k]
        self.n = 3
        self._lines = lines

    def tobytes(self, form):
        return json.dumps(self._lines).encode()


def open(stream, filetype):  # noqa: A001
    return Document(stream)

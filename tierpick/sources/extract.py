"""Rows of compressed responses, unpacked piece by piece."""

import base64
import codecs
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa

PIECE = 1 << 20        # characters of base64 decoded at once
_UNPACKED = 1 << 22    # bytes of JSON unpacked at once
_BATCH = 1 << 22       # characters of rows sent on at once
_BLANK = " \t\r\n"
_NUMBER = "-0123456789"


def gunzip(body: memoryview) -> Iterator[bytes]:
    """Unpacked bytes of base64(gzip(...)), in pieces; a body may have several members.

    Line breaks in the base64 text are passed over. A body that ends early is an error.
    """
    inflate, rest, begun = zlib.decompressobj(31), "", False
    for at in range(0, len(body), PIECE):
        text = rest + "".join(str(body[at:at + PIECE], "ascii").split())
        whole = len(text) // 4 * 4
        data, rest = base64.b64decode(text[:whole]), text[whole:]
        while data:
            if inflate.eof:
                inflate = zlib.decompressobj(31)
            begun = True
            yield inflate.decompress(data, _UNPACKED)
            data = inflate.unconsumed_tail or inflate.unused_data
    if rest or begun and not inflate.eof:
        raise ValueError("a compressed response ends early")


def elements(pieces: Iterator[bytes]) -> Iterator[str]:
    """The texts of the elements of a JSON array that comes in pieces.

    Only the element at hand and one piece are held. No text at all has no elements.
    """
    decoder, utf8 = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8")()
    text, at, more = "", 0, True

    def grow(least: int) -> bool:
        """Forget what has been read and take in at least so many characters, if there are any."""
        nonlocal text, at, more
        held, size = [text[at:]], 0
        while more and size <= least:
            piece = next(pieces, None)
            more = piece is not None
            held.append(utf8.decode(piece or b"", final=not more))
            size += len(held[-1])
        text, at = "".join(held), 0
        return size > 0

    def skip(characters: str) -> str:
        """The next character that isn't one of these; empty at the end."""
        nonlocal at
        while True:
            while at < len(text) and text[at] in characters:
                at += 1
            if at < len(text):
                return text[at]
            if not grow(0):
                return ""

    mark = skip(_BLANK)
    if not mark:
        return
    if mark != "[":
        raise ValueError("a response is no JSON array")
    at, first = at + 1, True
    while True:
        mark = skip(_BLANK)
        if mark == "]":
            at += 1
            if skip(_BLANK):
                raise ValueError("a response goes on behind its array")
            return
        if not first:
            if mark != ",":
                raise ValueError("a response ends early or lacks a comma")
            at += 1
            mark = skip(_BLANK)
        wanted = 0
        while True:
            try:
                end = decoder.raw_decode(text, at)[1]
                # A number may go on where the text so far ends.
                whole = mark not in _NUMBER or end < len(text) and text[end] in _BLANK + ",]"
                if whole or not more:
                    break
            except json.JSONDecodeError as error:
                if not more:
                    raise ValueError("a response ends early or is no JSON") from error
            # Twice as much each time, so that a long element is not read over and over.
            wanted = max(2 * wanted, len(text) - at)
            grow(wanted)
        yield text[at:end]
        at, first = end, False


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body: a row per element of each response; null responses have none."""
    for batch in batches:
        held, size = [], 0
        for cell in batch.column(0):
            if not cell.is_valid:
                continue
            for element in elements(gunzip(memoryview(cell.as_buffer()))):
                held.append(element)
                size += len(element)
                if size >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["element"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["element"])

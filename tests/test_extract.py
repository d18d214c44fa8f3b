import base64
import gzip
import json
import random
import subprocess
import sys

import pytest

from tierpick.sources import extract, tables


def packed(data: bytes) -> str:
    return base64.b64encode(gzip.compress(data, 1)).decode()


def pieces(data: bytes, rng):
    at = 0
    while at < len(data):
        n = rng.randint(1, 9)
        yield data[at:at + n]
        at += n


def test_elements_of_arrays_in_any_pieces():
    rng = random.Random(1)
    values = [{"a": 1}, {"b": "x]},{\"é\\"}, [1, [2]], 12345, -1.5e3, "t,]", None, {}, {"c": {"d": []}}]
    for n in range(60):
        data = [rng.choice(values) for _ in range(rng.randint(0, 7))]
        text = json.dumps(data, indent=rng.choice([None, 2]), ensure_ascii=n % 2 == 0).encode()
        found = list(extract.elements(pieces(b" \n" * (n % 3) + text + b" ", rng)))
        assert [json.loads(e) for e in found] == data
    assert list(extract.elements(iter([b"", b" "]))) == []


@pytest.mark.parametrize("text", ["[1, 2", "[1 2]", "{}", "[1] 2", "[{\"a\": ", "[,1]", "[1,]"])
def test_broken_arrays_are_errors(text):
    with pytest.raises(ValueError):
        list(extract.elements(iter([text.encode()])))


def test_bodies_of_several_members_and_lines(monkeypatch):
    monkeypatch.setattr(extract, "PIECE", 7)
    monkeypatch.setattr(extract, "_UNPACKED", 5)
    body = base64.encodebytes(gzip.compress(b"[1,") + gzip.compress(b"23]")).decode()
    assert b"".join(extract.gunzip(memoryview(body.encode()))) == b"[1,23]"
    with pytest.raises(ValueError):
        list(extract.gunzip(memoryview(packed(b"[1]" * 99)[:-8].encode())))
    assert list(extract.gunzip(memoryview(b""))) == []


def test_rows_of_responses(rows):
    bodies = rows("entries string", (packed(json.dumps([{"id": i, "x": "y"} for i in range(5000)]).encode()),),
                  (None,), ("",), (packed(b"[]"),), (packed(b'[{"id": 7}, null]'),))
    out = tables.land_extract(bodies, "id bigint, name string").collect()
    assert sorted((r["id"] is None, r["id"] or 0) for r in out) == sorted(
        [(False, i) for i in range(5000)] + [(False, 7), (True, 0)])


LARGE = """
import base64, resource, sys, zlib
import pyarrow as pa
sys.path.insert(0, {root!r})
from tierpick.sources import extract

def body(total):
    pack, block = zlib.compressobj(1, zlib.DEFLATED, 31), (b'{{"id": 1, "name": "' + 400 * b'n' + b'"}},') * 20000
    out = [pack.compress(b"[")]
    for _ in range(total // len(block)):
        out.append(pack.compress(block))
    out += [pack.compress(b'{{"id": 0}}]'), pack.flush()]
    return base64.b64encode(b"".join(out)), total // len(block) * 20000 + 1

cell, n = body(1 << 30)
resource.setrlimit(resource.RLIMIT_DATA, (512 << 20, 512 << 20))
batch = pa.RecordBatch.from_arrays([pa.array([cell.decode()])], ["entries"])
print(sum(len(b) for b in extract.cut(iter([batch]))) == n)
"""


def test_a_gigabyte_in_a_worker_of_half_of_that():
    root = tables.__file__.rsplit("/tierpick/", 1)[0]
    done = subprocess.run([sys.executable, "-c", LARGE.format(root=root)], timeout=200,
                          capture_output=True, text=True)
    assert done.stdout.strip() == "True", done.stderr[-500:]

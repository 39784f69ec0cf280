"""Token files: exact round trip, single documents, damage, odd rows, and the plain format."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from tests.llm.util import ODD, SMALL, docs

from tidemark.llm import packing, registry, token_files
from tidemark.llm.common import shared_dir


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def rows_of(rows):
    """The contract, by the library itself."""
    t, at, out = library(), 0, []
    for doc, text in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_query_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = registry.QUERIES["op12_token_files"](spark, SMALL).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == rows_of(rows)


def written(spark, frame, name, **options):
    folder = f"{shared_dir(spark)}/test-{name}-{random.getrandbits(60)}"
    return folder, token_files.write_tokens(frame, folder, lambda: lambda text: [ord(c) for c in text], end_id=2, **options)


def test_odd_rows_and_single_documents(spark):
    rows = [(i, t, s) for i, t, s in ODD] + [(9, "hot", "a")] * 40
    folder, manifest = written(spark, docs(spark, rows), "odd", frame_ids=1000, file_bytes=64)
    assert manifest.agg({"n_docs": "sum"}).head()[0] == len(rows)
    got = token_files.read_tokens(spark, folder).orderBy("start").collect()
    texts = sorted(([*map(ord, t or ""), 2] for _, t, _ in rows), key=repr)
    assert sorted((np.frombuffer(r["ids"], "<u4").tolist() for r in got), key=repr) == texts
    assert [r["doc_id"] for r in got] == [None, None, *sorted(i for i, _, _ in rows if i is not None)]
    ends = np.cumsum([len(r["ids"]) // 4 for r in got]).tolist()
    assert [r["start"] for r in got] == [0, *ends[:-1]]
    wanted = spark.createDataFrame([(7,), (4,), (99,)], "doc_id long")
    some = token_files.read_tokens(spark, folder, wanted).collect()
    assert sorted(r["doc_id"] for r in some) == [4, 4, 7] and all(r in got for r in some)
    folder, manifest = written(spark, docs(spark, rows).limit(0), "empty")
    assert manifest.count() == 0 and token_files.read_tokens(spark, folder).count() == 0


def one_file(rows, **options):
    out = io.BytesIO()
    w = token_files.Writer(out, **options)
    for doc, ids in rows:
        w.add(doc, np.array(ids, np.uint32))
    w.close()
    return out.getvalue()


def test_format():
    rng = random.Random(5)
    rows = [(i if i % 5 else None, [rng.randrange(60000) for _ in range(rng.choice([0, 1, 7, 300]))]) for i in range(60)]
    data = one_file(rows, id_bytes=2, frame_ids=100)
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(plain, "<u2").tolist() == [x for _, ids in rows for x in ids]  # any reader takes it
    r = token_files.Reader(pa.BufferReader(data))
    assert r.doc_ids == [d for d, _ in rows]
    wanted = sorted(rng.sample(range(60), 20))
    assert [(k, ids.tolist()) for k, ids in r.read(wanted)] == [(k, rows[k][1]) for k in wanted]
    with pytest.raises(ValueError):
        one_file([(1, [70000])], id_bytes=2)


def test_only_wanted_frames_are_read_and_damage_is_seen():
    rows = [(i, list(range(i * 50, i * 50 + 40))) for i in range(30)]
    data = bytearray(one_file(rows))
    r = token_files.Reader(pa.BufferReader(bytes(data)))
    a, b = int(r.offsets[r.first_frame[4]]), int(r.offsets[r.first_frame[5]])
    for k in range(a, b):
        data[k] ^= 0x55
    broken = token_files.Reader(pa.BufferReader(bytes(data)))
    others = [k for k in range(30) if k != 4]
    assert [ids.tolist() for _, ids in broken.read(others)] == [rows[k][1] for k in others]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(broken.read([4]))
    raw = np.array(rows[4][1], "<u4").tobytes()
    frame = zstandard.ZstdCompressor(level=3).compress(raw[:-1] + b"\x01")  # a sound frame with other ids
    if len(frame) == b - a:
        data[a:b] = frame
        with pytest.raises(ValueError):
            list(token_files.Reader(pa.BufferReader(bytes(data))).read([4]))
    with pytest.raises(ValueError):
        token_files.Reader(pa.BufferReader(bytes(data[:-1]) + b"?"))


def test_encoder_is_the_library(spark):
    t, encode = library(), packing.encoder(*registry.byte_bpe(), added_tokens=True)
    for text in ["", "a<|endoftext|>b", "naïve 😀 " * 50, "x" * 5000]:
        assert encode(text) == t.encode(text, add_special_tokens=False).ids

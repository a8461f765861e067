import base64
import hashlib
import random
import struct

import numpy as np
import pytest

from skein.llm import bpe

from odd import ODD


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_part_of_random_texts(library):
    coder, rng = bpe.Coder(), random.Random(4)
    parts = ["a", "B", "1", " ", "  ", "\n", "'s", "é", "\x1c", "\x85", "​", "中", "😀", ".", "!!", "\0", "\t", "<|endoftext|>", "naïve"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    ids = coder.encode(texts)
    for text, got in zip(texts, ids, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        start, end = coder.offsets(got)
        assert (end[-1] if len(end) else 0) == len(text) and (start <= end).all()
        assert (start[1:] <= end[:-1]).all()  # a token begins where the one before ends, or inside its last character
    assert coder.decode(ids) == [t.encode() for t in texts]


def test_the_table_of_matches_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 3)
    coder = bpe.Coder()
    for text in ("some words that fill the table", "and others", "some words again"):
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == library.encode_ordinary(text)
    assert len(coder.known) <= 3 and len(coder.again) <= 3


def test_every_document_as_the_library_encodes_it(spark, library):
    """Ids of all texts of a given table by the file of ranks, and by the same vocabulary as JSON."""
    import public_tokenizers

    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for coder in (bpe.Coder(), bpe.Coder(public_tokenizers.path("byte_bpe_50k.json"))):
        for at in range(0, len(texts), 100):
            some = texts[at : at + 100]
            ids = coder.encode(some)
            assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [library.encode_ordinary(t or "") for t in some]
            assert coder.decode(ids) == [(t or "").encode() for t in some]


def test_digests_of_odd_rows(docs_of, library):
    got = sorted(map(tuple, bpe.digests(docs_of(ODD, extra=True)).collect()), key=str)
    want = []
    for i, t, _ in ODD:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.digests(docs_of([])).collect() == []


def test_encode_then_decode(docs_of):
    rows = [r for r in ODD if r[0] in (4, 10)]
    encoded = bpe.encode(docs_of(rows), offsets=True)
    assert all(len(r.starts) == len(r.ends) == r.n_tokens for r in encoded.collect())
    assert {r.doc_id: r.text for r in bpe.decode(encoded).collect()} == {i: t for i, t, _ in rows}

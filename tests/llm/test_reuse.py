import hashlib
import random

import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm import reuse as R
from tessera.llm.tokens import Encoder, default_path


def want(text, tok):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    back = tok.decode(ids, skip_special_tokens=False)
    return (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


def check(docs, **how):
    tok = Tokenizer.from_file(default_path())
    key = lambda r: -1 if r.doc_id is None else r.doc_id
    exp = sorted((key(r), *want(r.text, tok)) for r in docs.collect())
    got = sorted((key(r), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in R.encode_documents(docs, **how).collect())
    assert got == exp


def test_equals_library_on_edge_cases(docs):
    check(docs)


def test_equals_library_on_given_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_shared_passages_are_reused_and_joins_repaired(spark):
    tok = Tokenizer.from_file(default_path())
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()
    passage = max((r.text for r in rows), key=len)
    texts = [r.text[:101] + passage + r.text[50:] for r in rows] + ["x" + passage + "  y", passage + "<|endoftext|> " + passage, "  " + passage]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    known = R.build_dictionary(d)
    assert known
    reuser = R.Reuser(known)
    for text, ids in zip(texts, reuser.encode_all(pa.array(texts))):
        assert ids.tolist() == tok.encode(text, add_special_tokens=False).ids
    assert reuser.reused > 0.8 * reuser.total
    check(d)


def test_cuts_depend_on_content_alone():
    a = "".join(chr(97 + i * i % 23) + (" " if i % 7 == 0 else "é") for i in range(9000))
    cut = lambda t: {t.encode()[x:y] for x, y in zip(*R.cuts(*R.T.byte_view(pa.array([t]))))}
    assert len(cut(a) & cut("some prefix " + a)) >= len(cut(a)) - 2
    assert b"".join(a.encode()[x:y] for x, y in zip(*R.cuts(*R.T.byte_view(pa.array([a]))))) == a.encode()


def test_encoder_on_white_space_and_specials():
    tok, enc = Tokenizer.from_file(default_path()), Encoder()
    for t in ("a  b", " a \n\n b  ", "\t\tx", "a  <|endoftext|>  b", "<|endoftext|><|endoftext|>", "a　　b c", "\x1c \x1fx", "it's  we'll"):
        assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids
        assert enc.decode(enc.encode(t).tolist()) == tok.decode(tok.encode(t, add_special_tokens=False).ids, skip_special_tokens=False)


def test_encoder_on_every_code_point():
    """Letter, number and space classes agree with the library's."""
    tok, enc = Tokenizer.from_file(default_path()), Encoder()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 128):
        t = " ".join(f"a{chr(c)}1 {chr(c)}" for c in points[k:k + 128])
        assert enc.encode(t).tolist() == tok.encode(t, add_special_tokens=False).ids, hex(points[k])


def test_empty_table(empty):
    assert R.encode_documents(empty).count() == 0


def test_exactly_the_best_chunks(spark):
    rng = random.Random(5)
    rows = [(rng.getrandbits(64) - (1 << 63), rng.choice([1, 2, 2, 3, 700, 10**12 + rng.randrange(50)])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "h long, saved long").repartition(3)
    order = [h for h, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for limit in (0, 1, 7, 999, 1000, 3000, 5999, 6000, 10_000):
        assert R.best_chunks(df, limit).tolist() == sorted(order[:limit])
    assert R.best_chunks(df.limit(0), 5).tolist() == []


def test_equal_savings_still_fill_the_dictionary(spark):
    """More chunks of one saving than the dictionary holds: it is full, not empty."""
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(600))
    texts = [text() for _ in range(12)] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert len(R.build_dictionary(df, limit=5)) == 5
    check(df, limit=5)
    assert R.build_dictionary(df, limit=0) == {}
    check(df, limit=0)

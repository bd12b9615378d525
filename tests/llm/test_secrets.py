import hashlib
import re

from tessera.llm import secrets as S


def brute(text):
    """Base spans by the contract's words, one kind at a time."""
    text = text or ""
    out = []
    rx = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [("assign", m.start(), m.end()) for m in re.finditer(rx, text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    order = ["assign", "access", "hex"]
    return sorted(out, key=lambda x: (x[1], order.index(x[0])))


def test_base_spans_equal_brute_force(docs):
    want = {}
    for r in docs.collect():
        b = brute(r.text)
        want[r.doc_id] = (*(sum(k == x[0] for x in b) for k in ("assign", "access", "hex")),
                          hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in b).encode()).hexdigest(), {f"{k}:{s}:{e}" for k, s, e in b})
    out = S.scan_documents(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        w = want[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == w[:4]
        assert w[4] <= set(r.spans.split(",")) | {""}
    assert sum(r.n_assign for r in out) >= 3 and sum(r.n_hex for r in out) >= 2 and sum(r.n_access for r in out) >= 2
    assert any("private_key" in r.spans and "github" in r.spans and "bearer" in r.spans for r in out)


def test_index_equals_full_scan(docs):
    """The trigram queries never lose a match of any rule."""
    full = []
    for r in docs.collect():
        for rule in S.RULES:
            for m in re.finditer(rule.pattern, r.text or "", re.A | (re.I if rule.any_case else 0)):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    full.append((-1 if r.doc_id is None else r.doc_id, f"{rule.kind}:{m.start()}:{m.end()}"))
    got = [(-1 if r.doc_id is None else r.doc_id, x) for r in S.scan_documents(docs).collect() for x in r.spans.split(",") if x]
    assert sorted(full) == sorted(got)


def test_queries():
    assert S.trigram_query("[0-9a-f]+") is True
    assert S.trigram_query("abcd") == ("and", frozenset({"abc", "bcd"}))
    assert S.trigram_query("AKIA[A-Z0-9]+") == ("and", frozenset({"aki", "kia"}))
    assert S.trigram_query("(cat|dog)s?x") == ("or", S._any([S._all(["cat", "atx"]), S._all(["cat", "ats", "tsx"]), S._all(["dog", "ogx"]), S._all(["dog", "ogs", "gsx"])])[1])
    assert S.trigram_query("ab?c*(xyz)+") == "xyz"
    assert S.trigram_query("(abc)?d") is True
    assert "oke" in S.trigrams_of(S.trigram_query(S.BASE[0].pattern, True))


def test_redaction_keeps_columns_and_clean_rows(docs):
    out = S.redact(docs)
    assert out.columns == docs.columns
    before = sorted((r.doc_id or -1, r.text or "") for r in docs.collect())
    after = sorted((r.doc_id or -1, r.text or "", r.n_chars, r.text) for r in out.collect())
    assert len(before) == len(after)
    for (i, a), (j, b, n, raw) in zip(before, after):
        assert i == j and (raw is None or n == len(raw))
        if not S.Scanner().scan(__import__("pyarrow").array([a]))[0]:
            assert a == b
        else:
            assert not S.Scanner(S.BASE[1:]).scan(__import__("pyarrow").array([b]))[0]


def test_empty_table(empty):
    assert S.scan_documents(empty).count() == 0 and S.redact(empty).count() == 0


def cleaned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    return [r.text for r in S.redact(rows).orderBy("doc_id").collect()]


def test_redaction_leaves_no_part_of_a_private_key(spark):
    import base64
    import random
    raw = base64.b64encode(random.Random(2).randbytes(1190)).decode()
    lines = [raw[i:i + 64] for i in range(0, len(raw), 64)]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    head = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF", ""]
    forms = [sep.join([begin, *x, *y]) for sep in ("\n", "\r\n", "\\n", " ", "\n    ", "\n> ", '\\n" +\n"') for x in (lines, head + lines if "\n" in sep else lines) for y in ([end], [])]
    forms += [begin + raw + end, begin + "\n" + raw, begin + "\n" + "\n".join(lines[:3]) + "\nMII"]
    for form, out in zip(forms, cleaned(spark, [f"see\n{f}" for f in forms])):
        assert out == "see\n[private_key]", (form, out)
    out = cleaned(spark, [f"a\n{f}\n\nb c d\n{f}\n-- e" for f in forms[:1]])
    assert out == ["a\n[private_key]\n\nb c d\n[private_key]\n-- e"]
    two = "\n".join([begin, *lines, begin, *lines, end, "text stays"])
    assert cleaned(spark, [two]) == ["[private_key]\n[private_key]\ntext stays"]
    assert cleaned(spark, [f"the line {begin} starts a key, we say"]) == ["the line [private_key] starts a key, we say"]


def test_long_slack_token_goes_whole(spark):
    assert cleaned(spark, ["x xoxb-" + "1a-" * 60 + "Z y"]) == ["x [slack] y"]


def test_many_begin_lines_cost_linear_time():
    import time

    import pyarrow as pa
    begin = "-----BEGIN PRIVATE KEY-----"
    t = time.time()
    for text in (f"{begin}\n" * 20_000, f"A: {begin}\n" * 20_000, f"{begin} " + "a" * 500_000 + "-", f"{begin}" + "- " * 300_000, f"{begin}\n" + "A:b\n" * 100_000):
        assert S.Scanner().scan(pa.array([text]))[0]
    assert time.time() - t < 20

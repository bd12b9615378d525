import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import pii as P

RX = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
      "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    s = sum(int(c) for c in d[-1::-2])
    return (s + sum(sum(divmod(2 * int(c), 10)) for c in d[-2::-2])) % 10 == 0


def brute(text):
    """The base rules in the contract's own words."""
    out = []
    for kind, rx in RX.items():
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and luhn(d)):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_brute_force_on_random_text():
    rng = random.Random(5)
    bits = ["a@b.c", "@", "x.y", "+", "1", "22", "4111 1111 1111 1111", "10.0.0.1", ".", "-", " ", "(", ")", "é", "256.1.1.1", "%", "@d.e", "0-", "+49 30 123456"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert P.base_spans(t) == brute(t), t


@pytest.fixture(scope="module")
def field(spark):
    return P.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_whole_tables(spark, docs, field):
    for d in (docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        want = {r.doc_id: brute(r.text) for r in d.collect()}
        out = P.find(d, field).collect()
        assert len(out) == d.count()
        for r in out:
            w = want[r.doc_id]
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in w) for k in P.KINDS]
            text = [f"{k}:{s}:{e}" for k, s, e in w]
            assert r.base_sha256 == hashlib.sha256(",".join(text).encode()).hexdigest()
            assert set(text) <= set(r.spans.split(",")) | {""}


def test_labels_spread_to_repeats_and_leave_strangers(field):
    text = ("Call +1 (974) 555-3436 or write to bob.smith@mail.example.com. Later he wrote 1 974 555 3436, "
            "order 8812345678 came, and bob.smith (at) mail.example.com answered.")
    base, every = field.spans(text)
    assert [k for k, *_ in base] == ["email", "phone"]
    got = {(k, text[s:e]) for k, s, e in every}
    assert ("phone", "1 974 555 3436") in got and ("email", "bob.smith (at) mail.example.com") in got
    assert len(every) == 4
    lone = "order 8812345678 and 1 974 555 3436 came"
    assert field.spans(lone) == ([], [])


def test_message_passing_equals_enumeration_on_a_tree(field):
    """On a chain without loops sum-product is exact."""
    import itertools

    import numpy as np
    _, nodes = P.mentions("+1 (974) 555-3436 then 1234567 then 99887766 end")
    assert len(nodes) == 3 and not P._skips(nodes)
    local = field.node(np.array([x[3] for x in nodes]))
    z = np.zeros((3, 5))
    for ys in itertools.product(range(5), repeat=3):
        if any(x[2] >= 0 and x[2] != y for x, y in zip(nodes, ys)):
            continue
        w = np.exp(sum(0 if x[2] >= 0 else local[i, y] for i, (x, y) in enumerate(zip(nodes, ys))) + sum(field.chain[a, b] for a, b in zip(ys, ys[1:])))
        for i, y in enumerate(ys):
            z[i, y] += w
    assert np.allclose(field.marginals(nodes), z / z.sum(axis=1, keepdims=True), atol=5e-3)


def test_edge_cases(spark, docs, empty, field):
    import time
    t = time.time()
    for text in ("a" * 300_000, "1" * 300_000, "a." * 100_000 + "@", "+" * 200_000, "1-" * 200_000, "1.1.1 " * 50_000, "x@y " * 50_000):
        field.spans(text)
    assert time.time() - t < 60
    assert P.find(empty, field).count() == 0
    assert P.fit(empty).spans("+1 (974) 555-3436, 1 974 555 3436")[0] == [("phone", 0, 17)]


@pytest.mark.parametrize("repeats", [1, 10, 30, 300])
@pytest.mark.parametrize("first", [True, False])
def test_every_repeat_of_a_base_value_is_labelled(field, repeats, first):
    phone, mail = "+1 (974) 555-3436", "bob.smith@mail.example.com"
    again = [f"then 1 974 555 3436 or order {8812345678 + 13 * i} and bob.smith (at) mail.example.com" for i in range(repeats)]
    text = " ".join([f"{phone} {mail}", *again] if first else [*again, f"{phone} {mail}"])
    base, every = field.spans(text)
    got = [text[s:e] for _, s, e in every]
    assert len(base) == 2 and len(every) == 2 + 2 * repeats
    assert got.count("1 974 555 3436") == got.count("bob.smith (at) mail.example.com") == repeats


def test_repeats_without_others_between(field):
    for n in (10, 30, 300):
        text = "+1 (974) 555-3436 " + "x 1 974 555 3436 " * n
        assert [k for k, *_ in field.spans(text)[1]] == ["phone"] * (n + 1)
        assert field.spans("x 1 974 555 3436 " * n) == ([], [])


def test_skips_tie_each_candidate_to_its_nearest_base_mention():
    import random
    rng = random.Random(3)
    for _ in range(300):
        nodes = [(i, i + 1, rng.choice([-1, -1, 4]), 0, rng.choice("ab")) for i in range(rng.randint(0, 12))]
        edges = P._skips(nodes)
        assert len(edges) == len(set(edges)) <= 2 * len(nodes)
        for i, x in enumerate(nodes):
            far = [abs(i - j) for j, y in enumerate(nodes) if y[2] >= 0 and y[4] == x[4]]
            if x[2] < 0 and far:
                assert min(far) in [abs(a - b) for a, b in edges if i in (a, b) and nodes[a + b - i][2] >= 0]


def test_messages_that_swing_do_not_end_the_job(field, monkeypatch):
    """With no round counted as still, the averaged beliefs decide."""
    text = "+1 (974) 555-3436 " + "x 1 974 555 3436 y 12.34.56 z " * 5
    nodes = P.mentions(text)[1]
    want = field.marginals(nodes)
    monkeypatch.setattr(P, "STILL", -1.0)
    got = field.marginals(nodes)
    assert np.allclose(got.sum(axis=1), 1) and np.abs(got - want).max() < 0.01


def test_skip_edges_against_enumeration(field):
    """Without chain potentials the skip edges of these texts form trees, on
    which sum-product is exact."""
    import copy
    import itertools
    own = copy.copy(field)
    own.chain = np.zeros_like(field.chain)
    for text in ("+1 (974) 555-3436 or 1 974 555 3436", "1 974 555 3436 mail bob.s@mail.example.com then +1 (974) 555-3436 and bob.s (at) mail.example.com",
                 "1 974 555 3436 x 1 974 555 3436 y 44 1234567 z 44 1234567"):
        nodes = P.mentions(text)[1]
        free = [i for i, x in enumerate(nodes) if x[2] < 0]
        assert free
        local, skips = own.node(np.array([x[3] for x in nodes])), P._skips(nodes)
        total = np.zeros((len(nodes), len(P.LABELS)))
        for labels in itertools.product(range(len(P.LABELS)), repeat=len(free)):
            y = [x[2] for x in nodes]
            for i, lab in zip(free, labels):
                y[i] = lab
            w = np.exp(sum(local[i, y[i]] for i in free) + sum(own.skip for a, b in skips if y[a] == y[b]))
            for i in range(len(nodes)):
                total[i, y[i]] += w
        assert np.allclose(own.marginals(nodes), total / total.sum(axis=1, keepdims=True), atol=5e-3), text

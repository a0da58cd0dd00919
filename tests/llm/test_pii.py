"""Personal data: patterns against plain expressions, the model's gradients and held-out accuracy, windows and spans."""

import hashlib
import random
import re

import numpy as np
import pytest

from vigilframe.llm import bilstm_crf as crf, pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def brute_base(text):
    out = [(0, *m.span()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        out += [(2, *m.span())] if 13 <= len(digits) <= 19 and luhn(digits) else []
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def shown(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def prose(rng, chars):
    return " ".join("".join(rng.choice("aeinrstlo") for _ in range(rng.randrange(2, 9))) for _ in range(chars // 5))[:chars]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    return [prose(rng, 900) + " " + pii._some_other(rng) + " " + prose(rng, 300) for _ in range(60)]


@pytest.fixture(scope="module")
def model(texts):
    return pii.train_model(texts)


def test_base_spans_equal_plain_expressions():
    rng = random.Random(2)
    parts = ["a", ".", "@", "b-", "1", "12", "256", "255", "007", ".", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "é", "x@y.z", "1.2.3.4", "\n", "9" * 13]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(25)))
        assert sorted(pii.base_spans(text)) == sorted(brute_base(text)), text
    long = "a" * 300_000 + "1" * 300_000 + "@" + "b." * 100_000 + "+" + "(" * 100_000
    assert pii.base_spans(long)[0] == (0, 0, len(long) - 100_002)  # in one pass


def test_gradients():
    rng = np.random.default_rng(5)
    model = crf.new_model(3, 1, hidden=4)
    for a in model.arrays():
        a += rng.normal(0, 0.3, a.shape).astype(np.float32)
    x, y = rng.integers(0, crf.N_INPUTS, (3, 7)).astype(np.uint8), rng.integers(0, 3, (3, 7))
    _, grads = crf.gradients(model, x, y)
    for a, g in zip(model.arrays(), grads):
        for at in [tuple(i) for i in np.argwhere(np.abs(g) > 0.01)[:4]]:
            before, step = a[at], 1e-2
            a[at] = before + step
            up = crf.gradients(model, x, y)[0]
            a[at] = before - step
            down = crf.gradients(model, x, y)[0]
            a[at] = before
            assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.05, abs=2e-3)


def test_batched_scores_and_best_paths(model):
    rng = random.Random(6)
    windows = sorted(([crf.inputs(prose(rng, n) + "1.2") for n in (3, 40, 40, 7, 90)]), key=len, reverse=True)
    lengths = np.array([len(w) for w in windows])
    x = np.zeros((lengths[0], len(windows)), np.uint8)
    for k, w in enumerate(windows):
        x[: len(w), k] = w
    scores = crf.emissions(model, x, lengths)
    paths = crf.viterbi(scores, model.transitions, lengths)
    for k, w in enumerate(windows):
        alone = crf.emissions(model, w[:, None], np.array([len(w)]))[:, :, 0]
        assert np.allclose(alone, scores[: len(w), :, k], atol=1e-4)
        h = {d: np.zeros(crf.HIDDEN, np.float32) for d in range(2)}
        c, plain = {d: np.zeros(crf.HIDDEN, np.float32) for d in range(2)}, np.tile(model.bias, (len(w), 1))
        for d in range(2):
            for t in range(len(w)) if d == 0 else reversed(range(len(w))):
                a = crf.squash(model.inputs[d][w[t]] + h[d] @ model.recurrence[d]).reshape(4, -1)
                i, f, o = (a[:3] + 1) / 2
                c[d] = f * c[d] + i * a[3]
                h[d] = o * crf.squash(c[d])
                plain[t] = plain[t] + h[d] @ model.outputs[d * crf.HIDDEN : (d + 1) * crf.HIDDEN]
        assert np.allclose(plain, alone, atol=1e-3)
        value = lambda p: sum(alone[t, p[t]] for t in range(len(p))) + sum(model.transitions[a, b] for a, b in zip(p, p[1:]))  # noqa: E731, B023
        for _ in range(50):
            other = paths[k].copy()
            other[rng.randrange(len(other)) :][: rng.randrange(1, 4)] = rng.randrange(5)
            assert value(paths[k]) >= value(other) - 1e-3
    quiet = crf.quiet(scores, model.transitions, lengths)
    assert all(not p.any() for p, q in zip(paths, quiet) if q)


def test_held_out_accuracy(model):
    rng = random.Random(77)
    others = [prose(rng, 700) for _ in range(40)]
    windows, labels = pii.labelled_windows(others, 900, 96, seed=4321)
    scanner = pii.Scanner(model, batch_windows=100)
    hit = missed = wrong = 0
    for text, spans, found in zip(windows, labels, scanner.model_spans(windows)):
        spans = {s for s in spans if s[2] < 95}
        got = {s for s in pii.reconciled(found, []) if s[2] < 95}
        hit, missed, wrong = hit + len(spans & got), missed + len(spans - got), wrong + len(got - spans)
    assert hit / (hit + missed) > 0.9 and hit / (hit + wrong) > 0.9
    clean = [prose(rng, 5000) for _ in range(20)]
    assert all(s == ([], []) for s in scanner.spans(clean))


def test_windows_cover_whole_texts_and_spans_at_their_edges(model):
    rng = random.Random(8)
    scanner = pii.Scanner(model, batch_windows=7)
    for n in (0, 1, 64, 65, 192, 255, 256, 257, 448, 449, 1000, pii.SLICE - 1, pii.SLICE, pii.SLICE + 70, 2 * pii.SLICE + 300):
        seen = np.zeros(n, int)
        for number, at, codes in scanner.windows(["x" * n]):
            assert number == 0 and len(codes) <= pii.WINDOW
            seen[at : at + len(codes)] += 1
        assert n == 0 or seen.min() >= 1 and seen.max() <= 2
    found = total = 0
    for lead in [*range(150, 290, 7), pii.SLICE - 20, pii.SLICE + 5]:
        text = f"{prose(rng, lead)} anna.meier (at) firma (dot) com {prose(rng, 400)}"
        at = text.index("anna.meier")
        total += 1
        found += (0, at, at + len("anna.meier (at) firma (dot) com")) in scanner.spans([text])[0][1]
    assert found >= 0.9 * total


def test_reconciled_is_the_best_disjoint_set():
    rng = random.Random(9)
    for _ in range(200):
        some = []
        for _ in range(rng.randrange(8)):
            a = rng.randrange(20)
            some.append((rng.randrange(4), a, a + rng.randrange(1, 6), float(rng.randrange(1, 9))))
        fixed = [(0, 5, 8), (1, 6, 7)][: rng.randrange(3)]
        free = [c for c in some if all(c[2] <= a or b <= c[1] for _, a, b in fixed)]
        best = 0.0
        for mask in range(1 << len(free)):
            chosen = sorted((free[k] for k in range(len(free)) if mask >> k & 1), key=lambda c: c[1])
            if all(p[2] <= q[1] for p, q in zip(chosen, chosen[1:])):
                best = max(best, sum(c[3] for c in chosen))
        gains = {}
        for c in free:
            gains[c[:3]] = max(c[3], gains.get(c[:3], 0))
        assert sum(gains[s] for s in pii.reconciled(some, fixed)) == best


def test_personal_data_of_documents(spark, model):
    rng = random.Random(10)
    rows = [(k, prose(rng, rng.randrange(700)) + f" {pii.MAKERS[k % 4](rng)} " + prose(rng, 50), "x", 1) for k in range(60)]
    rows += [(7, "mail a.b@c.de or +49 30 1234567 now", "x", 2)] * 2 + [(None, "1.2.3.4", "x", 3), (99, None, "x", 4), (98, "", "x", 5)]
    rows += [(97, prose(rng, 300_000) + " a@b.cd 4111 1111 1111 1111", "x", 6)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spans string, n_email int").repartition(3)
    got = pii.find_personal_data(df, model).collect()
    scanner = pii.Scanner(model)
    want = []
    for i, text, _, _ in rows:
        base = brute_base(text or "")
        every = scanner.spans([text or ""])[0][1]
        assert set(base) <= set(every)
        counts = [sum(s[0] == k for s in base) for k in range(4)]
        want.append((i, *counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), len(every)))
    key = lambda r: (r[0] is None, r[0] or 0, r[6])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert any(r.n_spans > r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)
    assert pii.find_personal_data(df.limit(0), model).count() == 0
    assert pii.sample_texts(df, 5) == pii.sample_texts(df.repartition(7), 5)
    assert pii.sample_texts(df.limit(0)) == [] and pii.train_model([], windows=64, epochs=1)

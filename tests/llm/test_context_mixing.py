"""Language-model scores: the base against plain counts, the mixer against a loop over bits, and what scores must satisfy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fernweave.llm import context_mixing as cm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def base(rows):
    """Plain counting: doc rows (id, text) -> (held_out, tokens, known, N, base) in the rows' order."""
    is_held = [zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2 for i, _ in rows]
    counts = Counter(t for (_, text), held in zip(rows, is_held, strict=True) if not held for t in [*words_of(text), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for (_, text), held in zip(rows, is_held, strict=True):
        tokens = [*words_of(text), None]
        out.append((held, len(tokens), sum(counts[t] > 0 for t in tokens), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)))
    return out


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["Zürich", "ÀB", "don't", "x" * 50]
    own = [rng.sample(vocabulary, 40) for _ in range(4)]
    return [(i, rng.choice(" \n\t").join(rng.choice(own[i % 4]) if rng.random() < 0.97 else f"new{rng.random()}" for _ in range(rng.choice([0, 1, 30, 300])))) for i in range(n)]


ROWS = corpus(160) + [(None, "no id"), (5, "again and again"), (5, "again and again"), (900, None), (901, ""), (902, " \x0b\t "), (903, "\x00 odd ퟿"), (904, "brand " * 3000)]


@pytest.fixture(scope="module")
def scored(spark):
    frame = spark.createDataFrame([(i, t, k, "x", 1) for k, (i, t) in enumerate(ROWS)], "doc_id long, text string, n_tokens int, id string, score int").repartition(5)
    return frame, cm.score_documents(frame, most_words=50, most_slots=16).collect()  # few words, so that many are scored by bytes and joined


def test_base_equals_plain_counts(scored):
    got = sorted((-1 if r.id is None else r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored[1])
    want = sorted((-1 if i is None else i, *b[:4], round(b[4], 6)) for (i, _), b in zip(ROWS, base(ROWS), strict=True))
    assert got == want


def test_scores_are_finite_and_equal_for_equal_texts(scored):
    rows = scored[1]
    assert all(math.isfinite(r.score) and r.score < 0 and r.bits_per_byte > 0 for r in rows)
    twice = [r.score for r in rows if r.id == 5 and r.n_tokens == 4]
    assert len(twice) == 2 and twice[0] == pytest.approx(twice[1], rel=1e-6)
    assert len({round(r.score, 5) for r in rows if r.id in (900, 901, 902)}) == 1  # an end alone


def test_held_out_texts_are_likelier_than_by_counts(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["the", "of", "and"]) + f" {kind}{rng.randint(0, 60)}" for _ in range(120))) for i in range(400) for kind in [rng.choice("abcd")]]
    held = [r for r in cm.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert held and sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)


def small_model(texts):
    parts = list(cm._tokens(t.encode() for t in texts))
    ids, n = np.unique(np.concatenate([t.ids for t, _ in parts]), return_counts=True)
    keep = (n > 2) & (ids != cm.END)
    order = np.argsort(-n[keep], kind="stable")
    lexicon = cm.Lexicon(ids[keep][order], np.concatenate([[len(texts), 0], n[keep][order]]), np.concatenate([[len(texts), int(n[~keep].sum())], n[keep][order]]), np.ones(257, np.int64))
    tables = np.zeros((2, 2 << 14), np.int64)
    for tokens, _ in parts:
        for _, d in cm.decisions(cm.Units(tokens, lexicon.symbols_of(tokens.ids), lexicon), 14):
            for k in range(2):
                np.add.at(tables[k], 2 * d.slots[k + 1] + d.bit, 1)
    return cm.Model(lexicon, 14, [cm.first_table(lexicon, 14), *(cm.states(t[::2], t[1::2]) for t in tables)], 1, 1, cm.Mixer())


def test_lockstep_equals_a_loop_over_bits():
    texts = [t for _, t in corpus(40, 3)]
    model = small_model(texts)
    for tokens, _ in cm._tokens(t.encode() for t in texts):
        for part, d in cm.decisions(cm.Units(tokens, model.lexicon.symbols_of(tokens.ids), model.lexicon), 14):
            got, owner = cm.score_bits(model, d), np.repeat(part, d.sizes)
            logits, cells = model.inputs(d)
            weights, costs = model.mixer.weights.ravel(), model.mixer.costs()
            own, left, before = [1.0] * cm.INPUTS, 0, None
            for i in range(len(owner)):
                if owner[i] != before or left == 0:
                    own, left, before = [1.0] * cm.INPUTS, cm.STEPS, owner[i]
                x = [float(logits[k][i] * weights[cells[k][i]]) for k in range(cm.INPUTS)]
                dot = sum(a * b for a, b in zip(x, own, strict=True))
                error = float(d.bit[i]) - 1 / (1 + math.exp(-dot))
                own = [w + cm.OWN_RATE * error * a for w, a in zip(own, x, strict=True)]
                left -= 1
                dot = min(cm.MOST, max(-cm.MOST, dot))
                cell = int((dot + cm.MOST) * (cm.FINE - 1) / (2 * cm.MOST))
                near = [costs[int(d.gate[i]) * 2 * cm.FINE + int(d.bit[i]) * cm.FINE + min(cm.FINE - 1, max(0, cell + e))] for e in (-1, 0, 1)]
                assert min(near) - 1e-6 <= got[i] <= max(near) + 1e-6


def test_bits_spell_the_text_out_again():
    """The bits are those of the words' codes, or of an escape, the bytes and a stop: reading them gives the tokens back."""
    texts = [t for _, t in corpus(30, 5)]
    lexicon = small_model(texts).lexicon
    words = {(int(v), int(n)): s for s, (v, n) in enumerate(zip(lexicon.values, lexicon.lengths, strict=True))}
    letters = {(int(v), int(n)): s for s, (v, n) in enumerate(zip(lexicon.letter_values, lexicon.letter_lengths, strict=True))}
    assert sum(2.0 ** -int(n) for n in lexicon.lengths) == 1.0 and sum(2.0 ** -int(n) for n in lexicon.letter_lengths) == 1.0
    known = dict(zip(lexicon.symbols.tolist(), lexicon.ids.tolist(), strict=True))
    for tokens, _ in cm._tokens(t.encode() for t in texts):
        bits = "".join(str(b) for _, d in cm.decisions(cm.Units(tokens, lexicon.symbols_of(tokens.ids), lexicon), 14) for b in d.bit)
        at, read = 0, []

        def symbol(code):
            nonlocal at
            value, n = 0, 0
            while (value, n) not in code:
                value, n, at = 2 * value + int(bits[at]), n + 1, at + 1
            return code[value, n]

        while at < len(bits):
            s = symbol(words)
            if s != 1:
                read.append(known.get(s, cm.END))
            else:
                spelt = []
                while (c := symbol(letters)) != 256:
                    spelt.append(c)
                read.append(bytes(spelt))
        assert len(read) == len(tokens.ids)
        for r, i, start in zip(read, tokens.ids.tolist(), tokens.starts.tolist(), strict=True):
            assert r == i if isinstance(r, int) else tokens.raw[start : start + len(r)].tobytes() == r


def test_scores_do_not_depend_on_neighbours():
    texts = [t for _, t in corpus(40, 3)]
    model = small_model(texts)

    def scores(group):
        out = np.zeros(len(group))
        for tokens, owner in cm._tokens(t.encode() for t in group):
            for part, d in cm.decisions(cm.Units(tokens, model.lexicon.symbols_of(tokens.ids), model.lexicon), 14):
                out += np.bincount(np.array(owner)[np.repeat(part, d.sizes)], cm.score_bits(model, d), len(group))
        return out

    assert scores(texts)[::3] == pytest.approx(scores(texts[::3]), rel=1e-5)


def test_empty_tables_and_no_training(spark):
    schema = "doc_id long, text string"
    assert cm.score_documents(spark.createDataFrame([], schema)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = cm.score_documents(spark.createDataFrame([(held, "never seen")], schema)).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and math.isfinite(row.score)


def test_long_texts(spark):
    rows = [(1, "so it goes " * 150_000), (2, "y" * 300_000), (3, "so it goes")]
    got = {r.id: r for r in cm.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), most_slots=14).collect()}
    assert got[1].n_tokens == 450_001 and got[2].n_tokens == 2
    assert all(math.isfinite(r.score) for r in got.values())

import math
import random

import numpy as np
import pytest

from lodestone.llm import leakage, mixing, quality
from lodestone.llm.leakage import leaks, suffix_array, without_leaks, words

DOCS = "doc_id long, text string, source string, item_id long, words string"
ITEMS = "item_id long, text string, suite string, doc_id long"


def plain_words(t):
    import unicodedata

    t = "".join(c for c in unicodedata.normalize("NFKC", t) if unicodedata.category(c) != "Cf").lower()
    out, cur = [], ""
    for c in t + " ":
        if c.isalnum():
            cur += c
        elif cur:
            out.append(cur)
            cur = ""
    return out


def longest(a, b):
    best = 0
    at = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            if x == y:
                at[i, j] = at.get((i - 1, j - 1), 0) + 1
                best = max(best, at[i, j])
    return best


def test_words():
    for t in ("Ｆｕｌｌ wi\xaddth, a_b c-d 12,5 Ärger!", "", "½ x²", "naïve’s"):
        assert words(t) == plain_words(t)


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(1)
    t = rng.integers(0, 3, 200)
    order = suffix_array(t, 16)
    got = [t[i : i + 16].tolist() for i in order]
    assert got == sorted(got)


def corpus(seed=2):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(10, 40))), "s", None) for i in range(25)]
    docs = []
    for d in range(300):
        w = [rng.choice(vocab) for _ in range(rng.randrange(0, 80))]
        if d % 2 == 0:
            src = rng.choice(items)[1].split()
            k = rng.randrange(0, len(src))
            part = src[k : k + rng.randrange(10, 40)]
            at = rng.randrange(0, len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", "."]) for x in part]
        docs.append((d, " ".join(w), "s", d, "x"))
    return docs + [(500, None, None, 1, None), (501, "", None, 1, None), (None, items[0][1], None, 1, None), docs[0]], items + [(90, None, None, 1), (91, "too short", None, 1), items[3]]


def test_leaks_equal_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = {}
    for i, t, *_ in items:
        for d, x, *_ in docs:
            if t and x and d is not None:
                n = longest(plain_words(t), plain_words(x))
                if n >= 13:
                    want[i, d] = n
    frames = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = leaks(*frames)
    assert {(r.item_id, r.doc_id): r.words for r in found.collect()} == want and len(want) > 20
    for r in found.collect()[:30]:
        text = plain_words(next(d for d in docs if d[0] == r.doc_id)[1])
        item = plain_words(next(i for i in items if i[0] == r.item_id)[1])
        part = text[r.doc_word : r.doc_word + r.words]
        assert any(item[k : k + r.words] == part for k in range(len(item)))
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 100)
    monkeypatch.setattr(leakage, "SHARD_WORDS", 50)
    assert {(r.item_id, r.doc_id): r.words for r in leaks(*frames).collect()} == want
    left = {r.doc_id for r in without_leaks(frames[0], found).collect()}
    assert left == {d[0] for d in docs} - {d for _, d in want}


def test_leaks_of_nothing(spark):
    docs, items = corpus()
    none_docs, none_items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert leaks(none_docs, spark.createDataFrame(items, ITEMS)).count() == leaks(spark.createDataFrame(docs, DOCS), none_items).count() == 0


def test_a_very_long_document(spark):
    text = "a b c " * 60_000 + " ".join(f"z{i}" for i in range(20))
    found = leaks(spark.createDataFrame([(1, text, None, None, None)], DOCS), spark.createDataFrame([(7, " ".join(f"z{i}" for i in range(3, 18)), None, None)], ITEMS)).collect()
    assert [(r.item_id, r.doc_id, r.words, r.doc_word) for r in found] == [(7, 1, 15, 180_003)]


@pytest.mark.parametrize("rate,most", [(0.3, 2), (1.7, 2), (4.0, 4), (0.0, 3), (1.0, 1)])
def test_critical_rates_invert_the_poisson_distribution(rate, most):
    u = (np.arange(20_000) + 0.5) / 20_000
    counts = (mixing.critical_rates(u, most) <= rate).sum(1)
    p = [math.exp(-rate) * rate**j / math.factorial(j) for j in range(most)]
    for j in range(most):
        assert abs((counts == j).mean() - p[j]) < 1e-4
    assert counts.max(initial=0) <= most and (np.diff(mixing.critical_rates(u, most), axis=1) > 0).all()


def test_mixture(spark):
    rng = random.Random(3)
    docs = []
    for i in range(3000):
        source = rng.choice(["Big One", "big-one", " BIG_ONE", "small", "other", None]) if i % 9 else "small"
        docs.append((i, "word " * rng.randrange(1, 60), source, None, None))
    docs += [(9001, None, "small", None, None), (9002, "", "small", None, None)]
    goals = [("big_one", 0.6, 2), ("small", 0.3, 3), ("absent", 0.1, 4), (None, 0.5, 1)]
    targets = spark.createDataFrame(goals, "source string, target_share double, max_repeats int")
    rows, report = mixing.mixture(spark.createDataFrame(docs, DOCS), targets)
    got = rows.collect()
    again = mixing.mixture(spark.createDataFrame(docs, DOCS).repartition(7), targets)[0].collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert [r.place for r in got] == sorted(r.place for r in got)
    per = {}
    for r in got:
        per[r.doc_id] = max(per.get(r.doc_id, 0), r.copy)
    source = {d[0]: d[2] for d in docs}
    assert all(n <= (3 if source[d] == "small" else 2) for d, n in per.items()) and not {9001, 9002} & per.keys()
    by = {r.source: r for r in report.collect()}
    # Shares are right to a document: at most 59 of some 70,000 tokens.
    assert by["big_one"].actual_share == pytest.approx(2 / 3, rel=0.002) and by["small"].actual_share == pytest.approx(1 / 3, rel=0.002)
    assert by["absent"].used_tokens == 0 and by["absent"].actual_share == 0 and by["other"].target_share is None and by["other"].used_tokens == 0
    assert sum(r.tokens for r in got) == sum(r.used_tokens for r in by.values())
    assert mixing.mixture(spark.createDataFrame([], DOCS), targets)[0].count() == 0
    assert mixing.mixture(spark.createDataFrame(docs, DOCS), targets.where("false"))[0].count() == 0


def test_a_stated_total_is_kept_within_caps():
    goals = mixing.goals_of({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 2)}, total_tokens=1000)
    assert goals == {"a": 200.0, "b": 500.0}
    assert mixing.goals_of({"a": 100, "b": 1000}, {"a": (0.5, 2), "b": (0.5, 2)}) == {"a": 200.0, "b": 200.0}


def test_long_texts_count_as_their_parts():
    rng = random.Random(2)
    for text in ("It's 12 plain words,  with   spaces.\n\n" * 50, "x" * 3000, " " * 700 + "\n" * 50 + "a", "".join(rng.choice("ab1 .'s\n\t") for _ in range(4000))):
        whole = mixing.count_tokens(mixing.VOCABULARY, text)
        assert all(mixing.count_tokens(mixing.VOCABULARY, text, piece) == whole for piece in (1, 7, 100, 1000))


COMMON = ["the", "a", "of", "and", "to", "in", "is", "it", "that", "was", "der", "die", "und", "nicht", "mit"]
PROSE = "The old reader counts what is left of the table, and it waits.\nNobody in the team was sure that it is right. "
KINDS = {
    1: (PROSE * 3, "prose"),
    2: ("\n".join(f"- plain thing {i}" for i in range(20)), "list"),
    3: ("\n".join(f"| item{i} | ready | {i * 37} | 0.{i} |" for i in range(20)), "table"),
    4: ("#####\n/////\n&&&& ====\n" * 6, "junk"),
    5: ("", "junk"),
    6: (None, "junk"),
    7: ("the reader waits in the hall and it is\nlate in the day, so that the\nold clock was the last to know. " * 4, "prose"),
    8: ("name: thing\nstate: ready\nbytes: 55\n\n" * 12, "table"),
    9: ("palette " * 200, "junk"),
    10: (PROSE + "\n".join(f"{i}. some entry (kind)" for i in range(40)), "list"),
    11: ("x; y; z; w;\nq; r; s; t\n" * 15, "list"),
    12: ("the and of is. to, in it that. was a the\n" * 12, "junk"),
}


def test_kinds_of_texts(spark):
    docs = [(i, t, None, None, None) for i, (t, _) in KINDS.items()]
    # Accuracies are learned from agreement, so each kind comes a few times.
    docs += [(100 * k + i, t, None, None, None) for k in range(1, 6) for i, (t, _) in KINDS.items()]
    common = spark.createDataFrame([(w, "en") for w in COMMON] + [(None, "en")], "word string, lang string")
    frame = spark.createDataFrame(docs, DOCS)
    got = {r.doc_id: r for r in quality.text_types(frame, common).collect()}
    assert {i: got[i].kind for i in KINDS} == {i: k for i, (_, k) in KINDS.items()}
    assert all(abs(sum(r[f"p_{k}"] for k in quality.KINDS) - 1) < 1e-6 for r in got.values())
    assert got[5].words == 0 and got[1].punctuated_lines == 1.0 and got[1].common_words > 0.3
    assert quality.text_types(frame.where("false"), common).count() == 0


def votes_of(truth, rates, seed=6):
    """Votes as bits: function j fires with rates[j][0] on its own kind, rates[j][1] on others."""
    rng, votes = np.random.default_rng(seed), np.zeros(len(truth), int)
    for j, (kind, own, other) in enumerate(rates):
        votes |= (rng.random(len(truth)) < np.where(truth == kind, own, other)).astype(int) << j
    return votes


def test_accuracies_are_learned_from_agreement_and_beat_the_majority():
    truth = np.random.default_rng(5).choice(4, 20_000, p=[0.55, 0.2, 0.15, 0.1])
    # Of the functions for kind 3 two fire on half of everything: as votes they mislead.
    rates = [(0, 0.8, 0.03), (0, 0.7, 0.05), (0, 0.6, 0.05), (1, 0.8, 0.03), (1, 0.7, 0.03), (2, 0.8, 0.03), (2, 0.7, 0.03), (3, 0.85, 0.01), (3, 0.6, 0.5), (3, 0.6, 0.5)]
    kinds = [k for k, _, _ in rates]
    votes = votes_of(truth, rates)
    pattern, count = np.unique(votes, return_counts=True)
    right, prior, posterior = quality.learn(list(zip(pattern.tolist(), count.tolist())), kinds)
    learned = np.array([posterior[v].argmax() for v in votes.tolist()])
    bits = (votes[:, None] >> np.arange(len(kinds)) & 1).astype(bool)
    counted = quality.majority(bits, np.array(kinds)).argmax(1)
    assert (learned == truth).mean() > 0.94 and (counted == truth).mean() < 0.9
    assert right[7] > 0.8 and right[8] < 0.2 and right[9] < 0.2 and abs(prior[0] - 0.55) < 0.05


def test_functions_overlap_and_abstain():
    common = frozenset(COMMON)
    more = ["1. of the and that is it\n2. a the to of in and\n3. is of that the", "qqq rrr " * 6, "- and so on."]
    seen = [quality.statistics(t or "", common)[1] for t in [*more, *[t for t, _ in KINDS.values()]]]
    patterns = {p for v in seen for p in v}
    assert any(p.bit_count() > 2 for p in patterns) and any(p.bit_count() <= 1 for p in patterns)
    kinds = np.array([k for _, k, _ in quality.FUNCTIONS])
    voted = [{int(k) for j, k in enumerate(kinds) if p >> j & 1} for p in patterns]
    assert any(len(v) > 1 for v in voted)  # functions contradict each other


def test_very_long_text():
    stats, votes = quality.statistics("the end is near and it was late. " * 20_000, frozenset(COMMON))
    assert stats[0] == 160_000 and sum(votes.values()) == 33 * 20_000 - 1 and len(votes) == 1

"""Text quality statistics and text types learned from noisy labelling functions.

Every line of a document has statistics (words, their length, frequent and distinct ones,
symbols, digits, delimiters, a closing mark), and so has the document. Thresholds on them
are labelling functions: each votes for one kind or abstains, several may speak on a line
and contradict each other. Their accuracies are learned on all lines of all documents by
expectation-maximization from how they agree, without any label; the posterior of a line's
votes is its type, and a document's type is that of the greater part of its characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import materialize

KINDS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
#: Frequent words are a fixed registry, shipped to the tasks up to this bound.
MAX_COMMON = 100_000

WORD = re.compile(r"[^\W_]+")
DIGITS = re.compile(r"[0-9]+")
#: What lines of letters, digits and usual marks don't hold.
ODD = re.compile(r"[^\w\s.,;:!?'\"()\[\]\-–—…«»¿¡“”„‘’/%&=+*#|>•·\\@]")
MARKS = frozenset("-*+•–—·>([")
MARK = re.compile(r"\s*(?:[-*+•–—·>]|\(?[0-9]{1,4}[.)]|\(?[a-zA-Z][.)]|\[[ xX]?\])\s+")
FIELD = re.compile(r"[^\W\d][\w .-]{0,30}[:=]\s*\S+(?: \S+)?\Z")
PAIR = re.compile(r"[^\W\d]\w*=\S")
ALIGNED = re.compile(r"\S(?: {2,}|\t)(?=\S)")
HEX = re.compile(r"\b[0-9a-f]{2}\b")
PATH = re.compile(r"(?:[^/\\:]{1,80}[/\\])+[^/\\]{1,120}\.\w{1,6}\Z")
#: Characters of category Cf, which have no width: soft hyphens, joiners, marks of direction.
FORMAT = frozenset(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cf")
NO_FORMAT = {ord(c): None for c in FORMAT}
#: Deletes the ASCII characters that ODD finds.
UNUSUAL_ASCII = {ord(c): None for c in map(chr, range(128)) if ODD.match(c)}
CLOSING = frozenset(".!?…;:\"'»”)")

STATS = ("words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words", "common_pairs", "digit_ratio", "words_per_line", "marked_lines", "delimited_lines")

#: Labelling functions of a line: name, kind, and thresholds on its statistics, which are
#: attributes of a Line.
FUNCTIONS = (
    ("long_and_common", PROSE, "words >= 8 and common >= 0.18 and not semicolons and not no_order and not odd"),
    ("common_words", PROSE, "words >= 6 and common >= 0.28 and mark < 0 and not no_order and not odd"),
    ("closed_sentence", PROSE, "closed and words >= 6 and common >= 0.12 and not odd"),
    ("varied_words", PROSE, "words >= 10 and distinct >= 0.6 and digits < 0.1 and common >= 0.12 and not delimited and not no_order and not odd"),
    ("flowing", PROSE, "flowing and not no_order"),
    ("marked_and_short", LIST, "mark >= 0 and 0 < words <= 9 and letters >= 0.4"),
    ("short", LIST, "0 < words <= 5 and letters >= 0.4 and word_length < 12 and not delimited and not odd and not no_order"),
    ("rarely_common", LIST, "0 < words <= 9 and common < 0.5 and letters >= 0.4 and word_length < 12 and not delimited and not flowing and not no_order"),
    ("enumeration", LIST, "semicolons >= 2 and words <= 3 * (semicolons + 1)"),
    ("path", LIST, "path"),
    ("list_around", LIST, "around_marked >= 0.6 and 0 < words <= 9"),
    ("bars", TABLE, "bars >= 2"),
    ("separated", TABLE, "separated"),
    ("field", TABLE, "field and mark < 0"),
    ("pairs", TABLE, "pairs >= 2"),
    ("aligned", TABLE, "words <= 9 and aligned >= 2 and letters > 0"),
    ("table_around", TABLE, "around_delimited >= 0.6 and words <= 14"),
    ("few_letters", JUNK, "letters < 0.4 and not delimited"),
    ("odd_signs", JUNK, "odd"),
    ("repeated_words", JUNK, "words >= 8 and distinct_of_24 <= 0.25"),
    ("codes", JUNK, "words >= 6 and hexes >= 0.6"),
    ("mixed_words", JUNK, "words >= 3 and mixed > 0.3 and not delimited"),
    ("no_words", JUNK, "words == 0 and not delimited"),
    ("long_words", JUNK, "word_length >= 16 and not path"),
    ("long_words_around", JUNK, "around_length >= 11"),
    ("unknown_words", JUNK, "words >= 10 and common < 0.12 and not delimited and semicolons < 2 and not path"),
    ("no_order", JUNK, "no_order and words > 0"),
)

#: Share of neighbouring words that are both frequent from which words are in no order.
NO_ORDER = 0.38


def _compiled() -> Callable[[Line], int]:
    """One function of a line that gives the votes of all FUNCTIONS as bits."""
    names = {n: f"x.{n}" for n in Line.__slots__}
    rules = [re.sub(r"\b[a-z_0-9]+\b", lambda m: names.get(m.group(), m.group()), rule) for _, _, rule in FUNCTIONS]
    return eval("lambda x: " + " | ".join(f"(1 << {j} if {rule} else 0)" for j, rule in enumerate(rules)))  # the rules above, nothing else


class Line:
    """The statistics of a stripped line that isn't blank.

    mark: words that belong to the mark of an item at its start, -1 without one; these are
    left out of the counts. Shares of letters, digits and odd signs are of what isn't space.
    """

    __slots__ = (
        "size", "words", "hits", "common", "distinct", "distinct_of_24", "word_length", "letters", "digits", "odd", "closed", "mark", "semicolons", "bars",
        "separated", "field", "pairs", "aligned", "hexes", "mixed", "path", "delimited", "ends", "flowing", "around_marked", "around_delimited", "around_length", "no_order",
    )

    def __init__(self, line: str, found: list[str], flags: list[bool]):
        first, spaces, tabs, commas = line[0], line.count(" "), line.count("\t"), line.count(",")
        mark = MARK.match(line) if first in MARKS or first.isdigit() or line[1:2] in (".", ")") else None
        self.mark = -1 if mark is None else len(WORD.findall(mark.group()))
        skip = max(self.mark, 0)
        own, n = found[skip:], len(found) - skip
        solid = max(1, len(line) - spaces - tabs)
        length, kinds = sum(map(len, own)), len(set(own))
        digits = DIGITS.findall(line)
        self.size, self.words, self.hits = len(line), n, sum(flags[skip:])
        self.common = self.hits / n if n else 0.0
        self.distinct = kinds / n if n else 0.0
        self.distinct_of_24 = kinds / min(n, 24) if n else 0.0
        self.word_length = length / n if n else 0.0
        self.letters = length / solid
        self.digits = sum(map(len, digits)) / solid
        self.odd = (len(line) - len(line.translate(UNUSUAL_ASCII)) if line.isascii() else len(ODD.findall(line))) > 0.04 * len(line)
        self.closed = line[-1] in CLOSING
        self.ends = line.count(". ") + line.count("! ") + line.count("? ") + (line[-1] in ".!?")
        self.semicolons, self.bars = line.count(";"), line.count("|")
        self.pairs = len(PAIR.findall(line)) if "=" in line else 0
        self.separated = tabs >= 2 or commas >= 2 and not spaces
        self.field = n <= 8 and (":" in line or "=" in line) and FIELD.match(line) is not None
        self.aligned = len(ALIGNED.findall(line)) if tabs or "  " in line else 0
        self.hexes = len(HEX.findall(line)) / n if n >= 6 and length < 4 * n else 0.0
        self.mixed = 1 - (sum(map(str.isalpha, own)) + sum(map(str.isdigit, own))) / n if n and digits else 0.0
        self.path = "/" in line and n <= 16 and PATH.match(line) is not None
        self.delimited = self.bars >= 2 or self.separated or self.pairs >= 2 or self.field or self.aligned >= 2 and n <= 9
        self.flowing = self.no_order = False
        self.around_marked = self.around_delimited = self.around_length = 0.0


def _flow(lines: list[Line]) -> None:
    """Mark the lines of wrapped paragraphs: neighbouring lines without marks or delimiters
    that together have frequent words and an end of sentence at least every 40 words."""
    i = 0
    while i < len(lines):
        j = i
        while j < len(lines) and lines[j].mark < 0 and not lines[j].delimited and not lines[j].odd and lines[j].semicolons < 2 and lines[j].letters >= 0.4:
            j += 1
        if j - i > 1:
            n = sum(x.words for x in lines[i:j])
            if n >= 8 and sum(x.hits for x in lines[i:j]) >= 0.18 * n and sum(x.ends for x in lines[i:j]) * 40 >= n:
                for x in lines[i:j]:
                    x.flowing = True
        i = max(j, i + 1)


def statistics(text: str, common: frozenset[str]) -> tuple[list[float], dict[int, int]]:
    """(values of STATS, characters of the lines by their votes as bits); blank: zeros, and
    one character without words."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if not FORMAT.isdisjoint(text):
            text = text.translate(NO_FORMAT)
    found: list[str] = []
    frequent: list[bool] = []
    lines = []
    solid = 0
    for line in text.splitlines():
        line = line.strip()
        if line:
            own = WORD.findall(line.lower())
            flags = [w in common for w in own]
            lines.append(Line(line, own, flags))
            found += own
            frequent += flags
            solid += len(line) - line.count(" ")
    if not lines:
        return [0.0] * len(STATS), {BLANK: 1}
    _flow(lines)
    n, k, length = len(found), len(lines), sum(map(len, found))
    pairs = sum(map(int.__and__, frequent, frequent[1:])) / max(1, n - 1)
    marked, delimited = sum(x.mark >= 0 for x in lines) / k, sum(x.delimited for x in lines) / k
    votes: dict[int, int] = {}
    for x in lines:
        x.no_order, x.around_marked, x.around_delimited, x.around_length = n >= 12 and pairs >= NO_ORDER, marked, delimited, length / max(1, n)
        v = VOTE(x)
        votes[v] = votes.get(v, 0) + x.size
    digits = sum(map(len, DIGITS.findall(text)))
    return [float(n), length / max(1, n), 1 - length / solid, sum(x.closed for x in lines) / k, sum(frequent) / max(1, n), pairs, digits / solid, n / k, marked, delimited], votes


VOTE = _compiled()
BLANK = 1 << [name for name, _, _ in FUNCTIONS].index("no_words")
VOTES = "votes array<struct<pattern: int, size: long>>"


def profile(documents: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, STATS and votes of every document.

    documents: doc_id, text; common: word (any language). Null and blank texts have no
    words and are noise. A text is used whole; lines that are blank count nowhere. Other
    columns are ignored, repeated rows give repeated results. votes: how many characters
    stand in lines of each pattern of votes.
    """
    rows = common.where("word IS NOT NULL").select(F.lower("word")).distinct().limit(MAX_COMMON + 1).collect()
    if len(rows) > MAX_COMMON:
        raise ValueError(f"more than {MAX_COMMON} frequent words")
    known = frozenset(r[0] for r in rows)
    kind = pa.list_(pa.struct([("pattern", pa.int32()), ("size", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [statistics(t or "", known) for t in batch["text"].to_pylist()]
            values = np.array([s for s, _ in made], float).reshape(batch.num_rows, len(STATS))
            votes = pa.array([[{"pattern": p, "size": n} for p, n in v.items()] for _, v in made], kind)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(values[:, i]) for i in range(len(STATS))], votes], names=["doc_id", *STATS, "votes"])

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS) + ", " + VOTES)


def learn(patterns: list[tuple[int, int]], kinds: list[int] | None = None, steps: int = 50) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(accuracies, priors, posterior of each pattern) by expectation-maximization.

    patterns: (votes as bits, how many); kinds: what each function votes for, those of
    FUNCTIONS by default. A function that votes for kind k on a line of kind y is right
    with its accuracy, which also sets how likely it stays silent on its own kind;
    agreement between functions is all that teaches it.
    """
    kind = np.array([k for _, k, _ in FUNCTIONS] if kinds is None else kinds)
    votes = np.array([[p >> j & 1 for j in range(len(kind))] for p, _ in patterns], bool).reshape(len(patterns), len(kind))
    count = np.array([c for _, c in patterns], float)
    # Start: lines belong to the kind that most functions vote for.
    belief = majority(votes, kind)
    for _ in range(steps):
        weight = belief * count[:, None]
        prior = (weight.sum(0) + 1) / (weight.sum() + 4)
        # P(vote | the line is of its kind) and P(vote | it is of another), smoothed.
        own = (np.array([(votes[:, j] * weight[:, k]).sum() for j, k in enumerate(kind)]) + 2) / (weight.sum(0)[kind] + 3)
        fired = (votes * count[:, None]).sum(0)
        other = (fired - np.array([(votes[:, j] * weight[:, k]).sum() for j, k in enumerate(kind)]) + 0.5) / (count.sum() - weight.sum(0)[kind] + 10)
        log = np.log(prior)[None, :].repeat(len(patterns), 0)
        for j, k in enumerate(kind):
            p = np.full(4, other[j])
            p[k] = own[j]
            p = p.clip(1e-4, 1 - 1e-4)
            log += np.where(votes[:, j, None], np.log(p), np.log(1 - p))
        log -= log.max(1, keepdims=True)
        belief = np.exp(log)
        belief /= belief.sum(1, keepdims=True)
    right = own * prior[kind] / (own * prior[kind] + other * (1 - prior[kind]))
    return right, prior, {p: b for (p, _), b in zip(patterns, belief)}


def majority(votes: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Share of the votes of each pattern that each kind has."""
    belief = np.full((len(votes), 4), 0.05)
    for k in range(4):
        belief[:, k] += votes[:, kind == k].sum(1)
    return belief / belief.sum(1, keepdims=True)


def text_types(documents: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id, STATS, kind and the share of each kind (p_prose, p_list, ...).

    A kind's share is the expected share of the document's characters in lines of that
    kind, by the posteriors of the lines' votes. A document is prose if at least half of
    it is; else it is of the kind of the greatest share among the others (ties in the order
    of KINDS). Patterns of votes are counted by a partial aggregate over all lines of all
    documents; there are at most 2 ** len(FUNCTIONS) of them, in practice some hundred.
    """
    voted = materialize(profile(documents, common))
    lines = voted.select("doc_id", F.explode("votes").alias("v"))
    patterns = [(r[0], r[1]) for r in lines.groupBy("v.pattern").agg(F.sum("v.size").alias("size")).orderBy("pattern").collect()]
    _, _, posterior = learn(patterns) if patterns else (None, None, {})
    shared = documents.sparkSession.sparkContext.broadcast(posterior)  # one entry a pattern

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = np.array([shares(v, shared.value) for v in batch["votes"].to_pylist()], float).reshape(batch.num_rows, 4)
            columns = [batch[c] for c in ("doc_id", *STATS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([kind_of(x) for x in share], pa.string()), *map(pa.array, share.T)], names=NAMES)

    kinds = ", ".join(f"p_{k} double" for k in KINDS)
    return voted.mapInArrow(run, "doc_id long, " + ", ".join(f"{x} double" for x in STATS) + ", kind string, " + kinds)


NAMES = ["doc_id", *STATS, "kind", *[f"p_{k}" for k in KINDS]]


def shares(votes: list[dict], posterior: dict[int, np.ndarray]) -> np.ndarray:
    """Expected share of the characters of each kind."""
    total = sum(v["size"] for v in votes)
    return sum(posterior[v["pattern"]] * v["size"] for v in votes) / total


def kind_of(share: np.ndarray) -> str:
    return KINDS[0] if share[PROSE] >= 0.5 else KINDS[1 + int(np.argmax(share[1:]))]

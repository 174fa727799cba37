"""Toxicity by a weighted lexicon matched with Aho-Corasick (operator 10).

Texts are folded first: lower case, homoglyphs to Latin letters, digits and signs that stand for
letters to those letters. The lexicon holds word beginnings with weights. Weights are learned on a
bounded sample of labelled rows (LEARN_ROWS, chosen by hash of doc_id; their texts are read whole, on executors, and
only counts of beginnings come to the driver). A beginning enters if it is found in MIN_DOCS toxic families of texts at
least (copies are one family), and significantly more often than chance (EVIDENCE, a log-likelihood ratio). Its weight is
the log odds at the lower end of the confidence interval of its toxic share, so that rare or less pure ones need company
to reach a verdict. A seed list gives well-known words a prior weight, unless the labels show harmless use. One automaton
over " beginning" strings matches all of them in one pass, so only word beginnings count, each word by its
heaviest; matches inside an exception phrase are dropped. The weights of distinct words are summed, a repeated word adding
less each time (a harmonic share), normalised by length, and squashed:
score = 1 - exp(-weight / (1 + log10(1 + words / LENGTH))), so length damps a score slowly and never outweighs a clear hit.

Defined cases: null or empty text scores 0; very long texts are read whole, a slice of rows (or one long row) at a time; ties in
choice of lexicon go to the alphabetically first; with no labelled rows the seed list alone is used; repeated rows score
alike, and rows that share a doc_id with a label all carry it; an empty table gives no rows; other columns pass through,
whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import arrow_batches, batch, dropped, saved, sliced, slices, table, texts, values

#: Labelled rows used for learning, at most; taken by hash of doc_id, the smallest first. Their texts are read whole.
LEARN_ROWS = 12_000
HELD_OUT_MOD = 5
SEED_LEXICON = (
    "idiot", "moron", "stupid", "scum", "loser", "trash", "pathetic", "worthless", "disgusting", "clown",
    "imbecile", "dumbass", "bastard", "retard", "cretin", "vermin", "filth", "degenerate",
)
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "clownfish", "class clown", "village idiot", "loser bracket", "idiot proof", "trash folder")
SEED_WEIGHT, MAX_WEIGHT, LENGTH = 3.0, 3.0, 500.0
#: Toxic families a beginning needs, the log-likelihood ratio it needs (chance reaches 26 once in 3 million tries), and its interval (deviations).
MIN_DOCS, EVIDENCE, INTERVAL = 6, 26.0, 1.64
MIN_STEM, MAX_STEM = 3, 12

# Look-alikes of Latin letters, and digits or signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ε": "e", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ⅰ": "i", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_FULL_WIDTH = {0xFF41 + i: chr(97 + i) for i in range(26)}
_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()} | _FULL_WIDTH | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None, 0xFEFF: None}
_DIGIT_FOLD = str.maketrans(DIGITS)
#: Runs of digits or signs; they stand for letters next to letters (see _as_letters).
_SIGNS = re.compile("[0-9@$!]+")
_NON_LATIN = re.compile("[­ıɑ-￿]")
_GAPS = re.compile(r"[\W_]+")


def _as_letters(m: re.Match) -> str:
    """A run before a letter becomes letters, and so does one of digits after a letter."""
    text, at, end = m.string, m.start(), m.end()
    if end < len(text) and text[end].isalpha() or at and text[at - 1].isalpha() and m[0].isdigit():
        return m[0].translate(_DIGIT_FOLD)
    return m[0]


def fold(text: str) -> str:
    """Lower case; homoglyphs and, within words, digit substitutions become letters; anything but letters and digits one blank."""
    low = text.lower()
    if _NON_LATIN.search(low):
        low = low.translate(_FOLD)
    low = _SIGNS.sub(_as_letters, low)
    return " " + _GAPS.sub(" ", low) + " "


def _family(words: set[str], label: int) -> tuple:
    """Alike for near copies with the same label: the long words with the smallest hashes."""
    rare = sorted(zlib.crc32(w.encode()) for w in words if len(w) >= 8)[:3]
    return (label, *rare) if len(rare) == 3 else (label, *sorted(words))


def beginnings(words: set[str], within: set[str] | None = None) -> list[str]:
    """The distinct beginnings of MIN_STEM to MAX_STEM letters of words; of `within` only, if given."""
    found = {w[:k] for w in words for k in range(MIN_STEM, min(len(w), MAX_STEM) + 1)}
    return sorted(found if within is None else found & within)


def weight_of(toxic: int, clean: int, n_toxic: int, n_clean: int) -> float:
    """A beginning's weight from the families that have it; 0 if it says too little."""
    n, base = toxic + clean, n_toxic / (n_toxic + n_clean)
    share = toxic / n if n else 0.0
    if toxic < MIN_DOCS or share <= base:
        return 0.0
    ratio = 2 * (toxic * math.log(share / base) + (clean * math.log((1 - share) / (1 - base)) if clean else 0.0))
    z = INTERVAL * INTERVAL
    low = (share + z / (2 * n) - INTERVAL * math.sqrt(share * (1 - share) / n + z / (4 * n * n))) / (1 + z / n)
    return min(MAX_WEIGHT, math.log(low / (1 - low))) if ratio >= EVIDENCE and low > 0.5 else 0.0


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """The lexicon, from numbers of families by beginning; a beginning that says no more than a shorter one of it is left out."""
    lexicon = {w: SEED_WEIGHT for w in SEED_LEXICON}
    if not n_toxic or not n_clean:
        return lexicon
    for s in [s for s in SEED_LEXICON if clean.get(s, 0) >= MIN_DOCS and clean[s] > 0.2 * (toxic.get(s, 0) + clean[s])]:
        del lexicon[s]  # seeds that this corpus uses harmlessly
    weights = {s: weight_of(n, clean.get(s, 0), n_toxic, n_clean) for s, n in toxic.items()}
    after: dict[str, list[str]] = {}
    for s in toxic:
        after.setdefault(s[:-1], []).append(s)
    for s in sorted((s for s, w in weights.items() if w), key=lambda s: (len(s), s)):
        shorter = max((lexicon.get(s[:k], 0.0) for k in range(MIN_STEM, len(s))), default=0.0)
        # The longest one that nearly all of its texts share says the same and matches fewer other words.
        while longer := [t for t in after.get(s, ()) if toxic[t] >= 0.95 * toxic[s]]:
            s = min(longer)
        if weights.get(s, 0.0) > shorter and s not in lexicon:
            lexicon[s] = weights[s]
    return lexicon


def learn_lexicon(rows: list[tuple[str, int]]) -> dict[str, float]:
    """The lexicon of a few (text, toxic) rows that are at hand; learned() does the same on executors."""
    seen, counts, families = set(), (Counter(), Counter()), [0, 0]
    for text, label in rows:
        words = set(fold(text).split())
        if (family := _family(words, label)) not in seen:
            seen.add(family)
            families[label] += 1
            counts[label].update(beginnings(words))
    return choose(counts[1], counts[0], families[1], families[0])


def automaton(lexicon: dict[str, float]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for s, w in lexicon.items():
        a.add_word(" " + s, (w, len(s)))
    for e in EXCEPTIONS:
        a.add_word(" " + fold(e).strip() + " ", (0.0, len(e) + 1))
    a.make_automaton()
    return a


def score_text(text: str, a: ahocorasick.Automaton) -> tuple[float, int]:
    """(score, hits) of one text."""
    if not text:
        return 0.0, 0
    folded = fold(text)
    best: dict[int, tuple[float, int]] = {}
    excused, ends = [], []
    for end, (w, n) in a.iter(folded):
        if w:
            best[end - n] = max((w, end), best.get(end - n, (0.0, 0)))
        elif not ends or end > ends[-1]:  # matches come by their end
            excused.append(end - n)
            ends.append(end)
    times: Counter = Counter()
    total = 0.0
    for at, (w, end) in best.items():
        k = bisect.bisect_right(ends, at + 1)
        if not (k < len(ends) and excused[k] <= at < ends[k] - 1):
            times[folded[at:end + 1]] += 1
            total += w / times[folded[at:end + 1]]
    if not times:
        return 0.0, 0
    return 1.0 - math.exp(-total / (1.0 + math.log10(1.0 + folded.count(" ") / LENGTH))), sum(times.values())


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, mod: int, held: int, rows: int) -> DataFrame:
    """(text, label) of at most `rows` labelled rows that aren't held out, chosen by hash; the same for any partitioning."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % mod != held)
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # Two numbers for each of at most `rows` rows: small enough to broadcast, so that texts aren't shuffled.
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def _families(rows: DataFrame, within: set[str] | None) -> DataFrame:
    """(family, stems) of labelled rows (text, label), a row a family."""
    out = pa.schema([("family", pa.string()), ("stems", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [set(fold(t).split()) for t in texts(b.column(0))]
            names = [hashlib.md5(repr(_family(w, y)).encode()).hexdigest() for w, y in zip(words, b.column(1).to_pylist(), strict=True)]
            yield batch(out, [names, [beginnings(w, within) for w in words]])

    arrow_batches(rows.sparkSession)
    return rows.select("text", F.col("label").cast("int")).mapInArrow(run, "family string, stems array<string>").groupBy("family").agg(F.min("stems").alias("stems"))


def _counts(families: DataFrame, least: int) -> tuple[dict[str, int], int]:
    """(families by beginning, of those in `least` of them at least; number of families)."""
    found = saved(families, "families")
    counts = found.select(F.explode("stems").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    result = {r.s: r.n for r in counts.collect()}, found.count()
    dropped(found)
    return result


def learned(documents: DataFrame, labels: DataFrame) -> dict[str, float]:
    """The lexicon of a sample of labelled rows, by counts on executors: of toxic families first, then of the same beginnings in clean ones."""
    sample = labelled_sample(documents, labels, "toxic", HELD_OUT_MOD, 0, LEARN_ROWS)
    toxic, n_toxic = _counts(_families(sample.where("label = 1"), None), MIN_DOCS)
    # What is in many toxic texts: bounded by the beginnings of a language's usual words.
    clean, n_clean = _counts(_families(sample.where("label = 0"), toxic.keys() | set(SEED_LEXICON)), 1)
    return choose(toxic, clean, n_toxic, n_clean)


def _scorer(lexicon: dict[str, float]):
    held: list = []

    def score(text: str) -> tuple[float, int]:
        if not held:
            held.append(automaton(lexicon))
        return score_text(text, held[0])

    return score


def score(df: DataFrame, lexicon: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and n_hits for each row."""
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("n_hits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _scorer(lexicon)
        for b in slices(batches):
            ids = values(b.column(0))
            found = [one(t) for t in texts(b.column(1))]
            held = [i is not None and zlib.crc32(str(i).encode()) % HELD_OUT_MOD == 0 for i in ids]
            yield batch(out, [b.column(0), held, [s for s, _ in found], [int(s >= 0.5) for s, _ in found], [n for _, n in found]])

    arrow_batches(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_hits long")


def without_toxic(df: DataFrame, lexicon: dict[str, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of df whose text scores under the threshold, all columns kept; only texts go to Python, and a verdict comes back."""
    held = _scorer(lexicon)

    def mild(column: pa.Array) -> pa.Array:
        return sliced(column, lambda part: [held(t)[0] < threshold for t in texts(part)], pa.bool_())

    arrow_batches(df.sparkSession)
    return df.where(F.arrow_udf(mild, "boolean")(df[text_col]))


def op10_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return score(documents, learned(documents, table(spark, sf_dir, "labels")))

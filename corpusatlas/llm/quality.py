"""Quality rules as a short-circuit cascade.

Base rules are counted for every text. The cascade's rules then run one after the other,
each only on the texts that no earlier rule has rejected. Their order comes from a sample:
for every rule the share it rejects and the time it takes a text are measured on the
executors, and the rule with most rejections per second goes first. The verdict is that no
rule rejects, so it does not depend on the order.

Defined cases: a null or empty text has no words, fails the base rules and is not kept;
repeated rows are each judged; an empty table gives an empty result; other columns are
not touched.
"""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusatlas.llm import textarrays as ta

#: Texts of the sample that the order is estimated on, about.
SAMPLE_TEXTS = 2_000
REPEAT_WINDOW = 5
#: Function words of the languages that the corpus may hold.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that it for on was be with as by at this from have or an not are "
    "de la le les et des du un une en que qui pour dans est sur au avec ce il "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "el los las y del se por con para su no lo más como".split()
)
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TOKEN = re.compile(rb"[^\x20\x09-\x0d]+")


class Slice:
    """One slice of texts with the counts that all rules may use."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hashing: ta.RangeHash):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.bounds = ta.words(data, offsets)
        self.n_words = np.diff(self.bounds)
        points = (data & 0xC0) != 0x80
        self.word_chars = ta.per_text(points & ~ta.is_space(data), offsets)
        self.n_symbols = ta.per_text(_SYMBOLS[data], offsets)
        self._hashing = hashing

    def __len__(self) -> int:
        return len(self.n_words)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()

    def repeats(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Repeated lines with a word, all lines with a word, words in repeated windows."""
        prefix = self._hashing.prefix(self.data)
        runs = ta.sequences(self._hashing.of(prefix, self.starts, self.ends), REPEAT_WINDOW)
        again = np.zeros(len(self), dtype=np.int64)
        for row in np.flatnonzero(self.n_words > REPEAT_WINDOW):
            begin, end = self.bounds[row], self.bounds[row + 1]
            own = runs[begin : end - REPEAT_WINDOW + 1]
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            if same.any():
                twice = np.zeros(len(own), dtype=bool)
                twice[order[1:][same]] = twice[order[:-1][same]] = True
                edges = np.zeros(end - begin + 1, dtype=np.int64)
                at = np.flatnonzero(twice)
                np.add.at(edges, at, 1)
                np.add.at(edges, at + REPEAT_WINDOW, -1)
                again[row] = np.count_nonzero(np.cumsum(edges))
        equal, lines = self._lines(prefix)
        return equal, lines, again

    def _lines(self, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Lines end at \n and at the end of their text.
        ends = np.union1d(np.flatnonzero(self.data == 10), self.offsets[1:])
        begins = np.concatenate([[0], np.where(np.isin(ends[:-1], self.offsets[1:]), ends[:-1], ends[:-1] + 1)])
        if len(ends) and ends[0] == 0:
            begins, ends = begins[1:], ends[1:]
        # A \n that is the last byte of a text leaves an empty rest: no word, so no count.
        words = np.searchsorted(self.starts, ends) - np.searchsorted(self.starts, begins)
        keep = (words > 0) & (ends > begins)
        begins, ends = begins[keep], ends[keep]
        text = np.searchsorted(self.offsets, begins, side="right") - 1
        hashes = self._hashing.of(prefix, begins, ends)
        order = np.lexsort((hashes, text))
        same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
        n = len(self)
        return np.bincount(text[order][1:][same], minlength=n), np.bincount(text, minlength=n)


Rule = Callable[[Slice, np.ndarray, dict], np.ndarray]


def _symbol_share(s: Slice, rows: np.ndarray, more: dict) -> np.ndarray:
    return 5 * s.n_symbols[rows] > s.n_words[rows]


def _word_length(s: Slice, rows: np.ndarray, more: dict) -> np.ndarray:
    chars, words = s.word_chars[rows], s.n_words[rows]
    return (chars < 2 * words) | (chars > 15 * words)


def _repeated_lines(s: Slice, rows: np.ndarray, more: dict) -> np.ndarray:
    return 10 * more["dup_lines"][rows] > 3 * more["lines"][rows]


def _letters(s: Slice, rows: np.ndarray, more: dict) -> np.ndarray:
    """Fewer than seven in ten words have a letter."""
    sums = np.concatenate([[0], np.cumsum(_LETTERS[s.data])])
    lettered = np.concatenate([[0], np.cumsum(sums[s.ends] > sums[s.starts])])
    have = lettered[s.bounds[rows + 1]] - lettered[s.bounds[rows]]
    return 10 * have < 7 * s.n_words[rows]


def _no_function_words(s: Slice, rows: np.ndarray, more: dict) -> np.ndarray:
    """A text of 50 words or more without two different function words."""
    known = {w.encode() for w in FUNCTION_WORDS}
    return np.array(
        [s.n_words[r] >= 50 and len(known.intersection(_TOKEN.findall(s.text(r).lower()))) < 2 for r in rows],
        dtype=bool,
    )


def _compressible(s: Slice, rows: np.ndarray, more: dict) -> np.ndarray:
    """A text of 1,000 bytes or more that shrinks to less than a tenth."""
    sizes = np.diff(s.offsets)[rows]
    return np.array(
        [n >= 1_000 and 10 * len(zlib.compress(s.text(r), 1)) < n for r, n in zip(rows, sizes)], dtype=bool
    )


RULES: dict[str, Rule] = {
    "symbol_share": _symbol_share,
    "word_length": _word_length,
    "repeated_lines": _repeated_lines,
    "letters": _letters,
    "no_function_words": _no_function_words,
    "compressible": _compressible,
}


def _base(s: Slice) -> tuple[dict, np.ndarray]:
    dup_lines, lines, again = s.repeats()
    failed = (s.n_words < 10) | (100 * again > 20 * s.n_words)
    return {"dup_lines": dup_lines, "lines": lines, "again": again}, failed


def rule_order(docs: DataFrame, rules: Sequence[str] = tuple(RULES), sample: int = SAMPLE_TEXTS) -> list[str]:
    """Rules by rejections per second on a hash sample of about `sample` texts."""
    total = docs.count()
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, total // sample))) == 0).select("text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = ta.RangeHash(5)
        spent, hit = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0)
        for batch in batches:
            for _, _, data, offsets in ta.slices(batch.column(0)):
                s = Slice(data, offsets, hashing)
                more, failed = _base(s)
                rows = np.flatnonzero(~failed)
                for name in rules:
                    began = time.perf_counter()
                    hit[name] += int(np.count_nonzero(RULES[name](s, rows, more)))
                    spent[name] += time.perf_counter() - began
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(rules)), pa.array([hit[r] for r in rules], pa.int64()), pa.array([spent[r] for r in rules], pa.float64())],
            names=["rule", "rejected", "seconds"],
        )

    found = (
        chosen.mapInArrow(measure, "rule string, rejected bigint, seconds double")
        .groupBy("rule").agg(F.sum("rejected").alias("n"), F.sum("seconds").alias("s")).collect()
    )
    gain = {r["rule"]: r["n"] / max(r["s"], 1e-9) for r in found}
    cost = {r["rule"]: r["s"] for r in found}
    # Rules that reject nothing in the sample go last, the cheapest first.
    return sorted(rules, key=lambda r: (-gain.get(r, 0.0), cost.get(r, 0.0), r))


def judged(docs: DataFrame, order: Sequence[str] | None = None) -> DataFrame:
    """Counts, base result and verdict for every row of `docs`."""
    order = list(order or rule_order(docs))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = ta.RangeHash(5)
        for batch in batches:
            for begin, end, data, offsets in ta.slices(batch.column(1)):
                s = Slice(data, offsets, hashing)
                more, failed = _base(s)
                alive = np.flatnonzero(~failed)
                for name in order:
                    if not len(alive):
                        break
                    alive = alive[~RULES[name](s, alive, more)]
                kept = np.zeros(len(s), dtype=bool)
                kept[alive] = True
                counts = [s.n_words, s.word_chars, s.n_symbols, more["dup_lines"], more["again"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(begin, end - begin),
                        *(pa.array(c.astype(np.int64)) for c in counts),
                        pa.array(failed), pa.array(kept),
                    ],
                    names=["doc_id", *_COUNTS, "base_failed", "kept"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        judge,
        f"doc_id {id_type}, " + ", ".join(f"{c} bigint" for c in _COUNTS) + ", base_failed boolean, kept boolean",
    )


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

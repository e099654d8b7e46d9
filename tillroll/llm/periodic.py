"""Periodic runs of words, by longest common extensions over a difference cover.

A run is a stretch of words with smallest period q (words q apart are equal), at least ``LEAST``
words and ``POWERS`` periods long, that no neighbouring word extends.

The words of many texts lie in one sequence of numbers, a number of its own between texts, so no
comparison passes a text's end. A difference cover modulo 13 samples 4 places of every 13 such
that any two places reach sampled ones by the same few steps. Only the sampled suffixes are
sorted: by text and their first 13 words, then by doubling, each step 13 words wide and only among
suffixes that are still equal. The doubling's ranks give the prefix that neighbours in that order
share, and a sparse table its range minima. A common extension then compares at most 12 words,
up to the synchronised samples, and asks the table for the rest. The same structure over the
reversed sequence extends to the left.

For each period p the grid of multiples of 3 p meets every stretch of 3 p equal pairs, so a text
of n words asks about n ln(n) / 3 times. Where the words p apart are equal at a grid place, both
extensions give the whole stretch. The same stretch turns up again with multiples of its period;
the smallest is kept.

A text is one unit of work: texts of a batch are cut into slices of bounded size, grid places are
asked in blocks of bounded number, so memory follows the longest text.

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed text;
texts are read whole; runs may overlap and are ordered by start, then period; repeated rows give
repeated results; a null doc_id stays null and ids of any width stay exact; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import WORD, ship_by_value, small_batches, table

#: A difference cover: the differences of these residues modulo MODULUS are all residues.
MODULUS = 13
RESIDUES = (0, 1, 3, 9)
#: Fewest words and fewest periods of a run. The grid's spacing is POWERS - 1 periods.
LEAST = 6
POWERS = 4
#: Characters of text in one sequence (a longer text has one of its own).
SLICE_CHARS = 1_500_000
#: Grid places asked at once.
GRID = 1 << 20

RESULT = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def _shifts() -> np.ndarray:
    """For residues a, b: the fewest steps after which both places are sampled."""
    sampled = np.isin(np.arange(MODULUS), RESIDUES)
    steps = np.empty((MODULUS, MODULUS), dtype=np.int64)
    for a in range(MODULUS):
        for b in range(MODULUS):
            steps[a, b] = next(d for d in range(MODULUS) if sampled[(a + d) % MODULUS] and sampled[(b + d) % MODULUS])
    return steps


class CommonExtension:
    """Longest common extensions to the right of two places of one text.

    ``words`` are numbers from 0; every text is followed by a number that occurs once."""

    def __init__(self, words: np.ndarray, text: np.ndarray):
        self.words = words
        self.shifts = _shifts()
        self.among = np.full(MODULUS, -1, dtype=np.int64)
        self.among[list(RESIDUES)] = np.arange(len(RESIDUES))
        places = np.arange(len(words))
        places = places[self.among[places % MODULUS] >= 0]
        levels, order = self._sort(places, text[places])
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.minima = self._range_minima(self._shared(places, order, levels), text[places])

    def _sample(self, place: np.ndarray) -> np.ndarray:
        """A sampled place's number among the sampled ones."""
        return place // MODULUS * len(RESIDUES) + self.among[place % MODULUS]

    def _sort(self, places: np.ndarray, text: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Ranks of the sampled suffixes by their first 13, 26, 52, ... words (equal ones share the
        first place among them), and the samples in order."""
        m = len(places)
        at = np.arange(m)
        width = max(1, int(self.words.max(initial=0)).bit_length())
        packed = max(1, 62 // width)
        padded = np.append(self.words, np.zeros(MODULUS, dtype=np.int64))
        keys = []
        for first in range(0, MODULUS, packed):
            key = np.zeros(m, dtype=np.int64)
            for offset in range(first, min(first + packed, MODULUS)):
                key = (key << width) | padded[places + offset]
            keys.append(key)
        order = np.lexsort((*reversed(keys), text))
        differs = np.ones(m, dtype=bool)
        differs[1:] = text[order][1:] != text[order][:-1]
        for key in keys:
            differs[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(m, dtype=np.int64)
        rank[order] = np.maximum.accumulate(np.where(differs, at, 0))
        levels = [rank]
        active = order[~(differs & np.append(differs[1:], True))]
        step = len(RESIDUES)
        while len(active):
            # no window of an active suffix holds its text's end, so the next sample exists
            before, follow = rank[active], rank[active + step]
            by_both = np.lexsort((follow, before))
            active, before, follow = active[by_both], before[by_both], follow[by_both]
            here = np.arange(len(active))
            new_group = np.ones(len(active), dtype=bool)
            new_group[1:] = before[1:] != before[:-1]
            new = new_group.copy()
            new[1:] |= follow[1:] != follow[:-1]
            start = np.maximum.accumulate(np.where(new_group, here, 0))
            rank = rank.copy()
            rank[active] = before + np.maximum.accumulate(np.where(new, here, 0)) - start
            levels.append(rank)
            active = active[~(new & np.append(new[1:], True))]
            step *= 2
        order = np.empty(m, dtype=np.int64)
        order[rank] = at
        return levels, order

    def _shared(self, places: np.ndarray, order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Words that each sorted suffix shares with the one before it."""
        shared = np.zeros(len(order), dtype=np.int64)
        if len(order) < 2:
            return shared
        a, b = order[:-1].copy(), order[1:].copy()
        length = np.zeros(len(a), dtype=np.int64)
        for level in range(len(levels) - 2, -1, -1):
            same = np.flatnonzero(levels[level][a] == levels[level][b])
            a[same] += len(RESIDUES) << level
            b[same] += len(RESIDUES) << level
            length[same] += MODULUS << level
        left, right = places[a], places[b]
        alive = np.arange(len(a))
        for offset in range(MODULUS):
            inside = right[alive] + offset < len(self.words)
            inside &= left[alive] + offset < len(self.words)
            alive = alive[inside]
            alive = alive[self.words[left[alive] + offset] == self.words[right[alive] + offset]]
            length[alive] += 1
        shared[1:] = length
        return shared

    @staticmethod
    def _range_minima(shared: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
        """Minima of 1, 2, 4, ... neighbours, as far as the samples of one text reach."""
        most = int(np.bincount(text).max(initial=1)) if len(text) else 1
        minima = [shared]
        width = 1
        while 2 * width <= most:
            last = minima[-1]
            minima.append(np.minimum(last[:-width], last[width:]) if len(last) > width else last[:0])
            width *= 2
        return minima

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Common extension of each pair of places, left before right, of one text."""
        steps = self.shifts[left % MODULUS, right % MODULUS]
        length = np.zeros(len(left), dtype=np.int64)
        alive = np.arange(len(left))
        met = []
        for offset in range(MODULUS):
            arrived = steps[alive] == offset
            met.append(alive[arrived])
            alive = alive[~arrived]
            alive = alive[self.words[left[alive] + offset] == self.words[right[alive] + offset]]
            length[alive] += 1
        met = np.concatenate(met)
        a = self.rank[self._sample(left[met] + steps[met])]
        b = self.rank[self._sample(right[met] + steps[met])]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        least = np.empty(len(met), dtype=np.int64)
        for k in np.unique(level):
            own = level == k
            minima = self.minima[k]
            least[own] = np.minimum(minima[low[own]], minima[high[own] - (1 << int(k))])
        length[met] += least
        return length


def grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, period) to ask: for every text and period the multiples of the spacing."""
    most = np.where(sizes >= LEAST, sizes // POWERS, 0)
    ends = np.cumsum(most)
    pairs, at = int(ends[-1]) if len(ends) else 0, 0
    while at < pairs:
        # so many (text, period) pairs that their places surely fit a block, or one pair
        number = np.arange(at, min(at + GRID, pairs))
        text = np.searchsorted(ends, number, side="right")
        period = number - (ends[text] - most[text]) + 1
        spacing = (POWERS - 1) * period
        places = (sizes[text] - period + spacing - 1) // spacing
        until = np.cumsum(places)
        fit = max(1, int(np.searchsorted(until, GRID, side="right")))
        text, period, spacing, places = text[:fit], period[:fit], spacing[:fit], places[:fit]
        first = np.cumsum(places) - places
        which = np.repeat(np.arange(fit), places)
        place = starts[text][which] + (np.arange(len(which)) - first[which]) * spacing[which]
        yield place, period[which]
        at += fit


def periodic_runs(texts: list[list]) -> list[np.ndarray]:
    """For each list of words its runs: rows of (start, length, period), by start, then period."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    number: dict = defaultdict(count().__next__)
    found = np.fromiter((number[w] for t in texts for w in t), dtype=np.int64, count=int(sizes.sum()))
    # one number of its own before the first and after every text
    starts = np.cumsum(sizes + 1) - sizes
    words = np.empty(len(found) + len(texts) + 1, dtype=np.int64)
    text = np.zeros(len(words), dtype=np.int64)
    own = np.ones(len(words), dtype=bool)
    own[np.append(starts - 1, len(words) - 1)] = False
    words[own] = found
    words[~own] = len(number) + np.arange(len(texts) + 1)
    text[own] = np.repeat(np.arange(len(texts)), sizes)
    # the number that ends a text belongs to it, read either way
    text[~own] = np.maximum(np.arange(len(texts) + 1) - 1, 0)
    right = CommonExtension(words, text)
    last = len(words) - 1
    text[~own] = np.minimum(np.arange(len(texts) + 1), max(len(texts) - 1, 0))
    left = CommonExtension(words[::-1].copy(), text[::-1].copy())
    parts = []
    for place, period in grid(starts, sizes):
        equal = words[place] == words[place + period]
        place, period = place[equal], period[equal]
        ahead = right(place, place + period)
        # in the reversed sequence the right one comes first; only the pair counts
        behind = left(last - (place + period - 1), last - (place - 1))
        length = ahead + behind + period
        long = length >= np.maximum(LEAST, POWERS * period)
        parts.append(np.stack([(place - behind)[long], length[long], period[long]], axis=1))
    runs = np.concatenate(parts) if parts else np.zeros((0, 3), dtype=np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    fresh = np.ones(len(runs), dtype=bool)
    fresh[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[fresh]  # one stretch: the smallest of its periods
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    bounds = np.searchsorted(runs[:, 0], np.append(starts, last + 1))
    out = []
    for k, start in enumerate(starts):
        rows = runs[bounds[k] : bounds[k + 1]].copy()
        rows[:, 0] -= start
        out.append(rows)
    return out


def collapse(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run contains after its first period, joined by one space."""
    if len(runs) == 0:
        return b" ".join(words).decode()
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()]).decode()


def slices(texts: list[str | None]) -> Iterator[list[list[bytes]]]:
    """The words of consecutive texts of bounded size together, or of one longer text."""
    taken: list[list[bytes]] = []
    chars = 0
    for text in texts:
        if taken and chars + len(text or "") > SLICE_CHARS:
            yield taken
            taken, chars = [], 0
        taken.append((text or "").encode().split())  # at ASCII white space
        chars += len(text or "")
    if taken:
        yield taken


def runs_of_batches(batches):
    """A mapInArrow function from (doc_id, text) to RESULT."""
    import pyarrow as pa

    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        rows, collapsed = [], []
        for texts in slices(batch.column(1).to_pylist()):
            found = periodic_runs(texts)
            rows += found
            collapsed += map(collapse, texts, found)
        offsets = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
        flat = np.concatenate([*rows, np.zeros((0, 3), dtype=np.int64)])
        fields = pa.StructArray.from_arrays([pa.array(flat[:, c].copy()) for c in range(3)], fields=list(kind))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), fields), pa.array(collapsed, pa.string())],
            names=["doc_id", "runs", "collapsed"],
        )


def find_periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) of every document."""
    ship_by_value(__name__)
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(runs_of_batches, RESULT)


def planted(docs: DataFrame) -> Column:
    """The text in which about a tenth of the documents become periodic from some word on.

    Which, from where and with what period follows from the id's checksum; a null id plants none."""
    h = F.crc32(docs["doc_id"].cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(docs["text"], F.lit(WORD), F.lit(0))
    n = F.nullif(F.size(words), F.lit(0))
    a = (g % n).cast("int")
    p = (F.floor((n - a) / (g % 8 + 3)) + 1).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    changed = F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")
    return F.when(h % 10 == 0, F.coalesce(changed, docs["text"])).otherwise(docs["text"])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, the longest one, and digests of all runs and of the collapsed text."""
    docs = table(spark, sf_dir, "documents")
    found = find_periodic_runs(docs.select("doc_id", planted(docs).alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))))
    text = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return (
        found.withColumn("best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            (-F.col("best.col2")).alias("start"),
            F.col("best.length").alias("length"),
            (-F.col("best.col3")).alias("period"),
            F.sha2(text.cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
        )
        .withColumn("exponent_milli", F.floor(F.expr("1000 * length div period")).cast("long"))
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
ORACLES: dict[str, str] = {}

"""Quality rules on repetition within a text, from a suffix array over its words.

The texts of a batch are turned into one sequence of word numbers. Prefix doubling sorts the
suffixes text by text, neighbours in that order give the longest common prefixes (Kasai's walk),
and a suffix's longer neighbour prefix is the longest substring from there that the text has
elsewhere too. The union of those of ``least_words`` or more is what maximal repeated substrings
cover. A text is kept if that is at most ``max_covered`` of its words and the longest repeat is
at most ``max_repeat`` words (and the base rules hold).

A text is one unit of work: texts of a batch are cut into runs of bounded size, so memory follows
the longest text, not the number of rows.

Defined results: a null, empty or blank text has no words and fails the base rules; texts are
judged whole; repeated rows give repeated results; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import beside_ids, ship_by_value, small_batches, table, texts_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
BASE_WINDOW = 5
BASE_WORDS = 10
BASE_PERCENT = 20
#: Repeats shorter than this many words are not counted as covered.
LEAST_WORDS = 8
MAX_COVERED = 0.2
MAX_REPEAT = 100
#: Characters of text sorted at once (a longer text is sorted alone).
RUN_CHARS = 1_500_000

RESULT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def suffix_ranks(words: np.ndarray, ends: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The place of every suffix among all, sorted by group and then by words.

    ``ends[i]`` is where the text of position i ends; a suffix that ends first sorts first, and
    of equal suffixes the one of the earlier text."""
    n = len(words)
    size = np.int64(2 * n + 2)
    here = np.arange(n, dtype=np.int64)
    order = np.lexsort((words, group))
    rank = np.empty(n, dtype=np.int64)
    first = np.ones(n, dtype=bool)
    first[1:] = (words[order][1:] != words[order][:-1]) | (group[order][1:] != group[order][:-1])
    rank[order] = np.maximum.accumulate(np.where(first, here, 0))
    shared = ~(first & np.append(first[1:], True))
    active = order[shared]
    step = 1
    while len(active):
        follow = active + step
        inside = follow < ends[active]
        after = np.where(inside, rank[np.where(inside, follow, 0)] + n + 1, ends[active])
        key = rank[active] * size + after
        by_key = np.argsort(key, kind="stable")
        active, key, old = active[by_key], key[by_key], rank[active][by_key]
        at = np.arange(len(active), dtype=np.int64)
        new_group = np.ones(len(active), dtype=bool)
        new_group[1:] = old[1:] != old[:-1]
        new_key = np.ones(len(active), dtype=bool)
        new_key[1:] = key[1:] != key[:-1]
        start = np.maximum.accumulate(np.where(new_group, at, 0))
        rank[active] = old + np.maximum.accumulate(np.where(new_key, at, 0)) - start
        active = active[~(new_key & np.append(new_key[1:], True))]
        step *= 2
    return rank


def neighbour_prefixes(
    words: np.ndarray, ends: np.ndarray, group: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array; and for each position the suffix sorted just before it in its group
    (-1: none) and the length of the prefix they share."""
    n = len(words)
    rank = suffix_ranks(words, ends, group)
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    before = np.full(n, -1, dtype=np.int64)
    same = group[order][1:] == group[order][:-1]
    before[order[1:][same]] = order[:-1][same]
    sequence, previous, stop = words.tolist(), before.tolist(), ends.tolist()
    prefix = [0] * n
    h = 0
    for i in range(n):
        j = previous[i]
        if j < 0:
            h = 0
            continue
        most = min(stop[i] - i, stop[j] - j)
        while h < most and sequence[i + h] == sequence[j + h]:
            h += 1
        prefix[i] = h
        if h:
            h -= 1
    return order, before, np.asarray(prefix, dtype=np.int64)


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the longest run of words from there that its text has elsewhere too."""
    if len(words) == 0:
        return np.zeros(0, dtype=np.int64)
    _, before, with_before = neighbour_prefixes(words, ends, ends)
    longest = with_before.copy()
    has = before >= 0
    np.maximum.at(longest, before[has], with_before[has])
    return longest


def covered(lengths: np.ndarray) -> np.ndarray:
    """Which positions the spans [i, i + lengths[i]) cover."""
    n = len(lengths)
    reach = np.maximum.accumulate(np.where(lengths > 0, np.arange(n) + lengths, 0))
    return reach > np.arange(n)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    return len(lines) - len(set(lines))


def judge(texts: list[str], rules: dict) -> list[tuple]:
    """The result columns after doc_id, one tuple per text."""
    numbers: dict = defaultdict(count().__next__)
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]  # at ASCII white space
    sizes = np.fromiter(map(len, split), dtype=np.int64, count=len(split))
    words = np.fromiter((numbers[w] for ws in split for w in ws), dtype=np.int64, count=int(sizes.sum()))
    stops = np.cumsum(sizes)
    ends = np.repeat(stops, sizes)
    longest = longest_repeats(words, ends)
    # spans stay within their text, so one pass over the run covers each text on its own
    window = rules["base_window"]
    in_windows = covered(np.where(longest >= window, window, 0))
    in_repeats = covered(np.where(longest >= rules["least_words"], longest, 0))
    out = []
    for text, n, stop in zip(texts, sizes.tolist(), stops.tolist()):
        own = slice(stop - n, stop)
        n_repeat = int(in_windows[own].sum())
        n_covered = int(in_repeats[own].sum())
        top = int(longest[own].max()) if n else 0
        failed = n < BASE_WORDS or 100 * n_repeat > BASE_PERCENT * n
        out.append(
            (
                n,
                len(text) - sum(map(text.count, BLANKS)),
                sum(map(text.count, SYMBOLS)),
                repeated_lines(text),
                n_repeat,
                n_covered,
                top,
                failed,
                not failed and n_covered <= rules["max_covered"] * n and top <= rules["max_repeat"],
            )
        )
    return out


def runs(texts: list[str], most: int = RUN_CHARS) -> Iterator[list[str]]:
    """Consecutive texts of at most ``most`` characters together, or one longer text."""
    run: list[str] = []
    chars = 0
    for text in texts:
        if run and chars + len(text) > most:
            yield run
            run, chars = [], 0
        run.append(text)
        chars += len(text)
    if run:
        yield run


def judge_batches(rules: dict):
    """A mapInArrow function over (doc_id, text)."""
    return beside_ids(lambda: lambda texts: [row for run in runs(texts) for row in judge(run, rules)], RESULT)


def _rules(least_words: int, max_covered: float, max_repeat: int) -> dict:
    return {
        "base_window": BASE_WINDOW,
        "least_words": least_words,
        "max_covered": max_covered,
        "max_repeat": max_repeat,
    }


def repetition_rules(
    docs: DataFrame,
    *,
    least_words: int = LEAST_WORDS,
    max_covered: float = MAX_COVERED,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """Base counts, repeat statistics and the verdict of every document."""
    ship_by_value(__name__)
    small_batches(docs.sparkSession)
    rules = _rules(least_words, max_covered, max_repeat)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge_batches(rules), RESULT)


def filter_batches(rules: dict, text_at: int):
    """A mapInArrow function that keeps the rows whose text (the column ``text_at``) is kept."""

    def filtered(batches):
        import pyarrow as pa

        for batch in batches:
            texts = list(texts_of(batch.column(text_at).to_pylist()))
            kept = [row[-1] for run in runs(texts) for row in judge(run, rules)]
            yield batch.filter(pa.array(kept, type=pa.bool_()))

    return filtered


def kept_documents(
    docs: DataFrame,
    *,
    least_words: int = LEAST_WORDS,
    max_covered: float = MAX_COVERED,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    ship_by_value(__name__)
    small_batches(docs.sparkSession)
    rules = _rules(least_words, max_covered, max_repeat)
    return docs.mapInArrow(filter_batches(rules, docs.columns.index("text")), docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules over the whole text of every document."""
    return repetition_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}

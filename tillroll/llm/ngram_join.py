"""Similarity join on word shingles by T-occurrence search.

A document's set holds the 64-bit hashes of its distinct five-word shingles. Two documents link
when 100 * intersection >= 75 * union. A set of n then shares at least T = ceil(0.75 n) with a
partner that is no larger, and lacks at most n - T of its own. All steps are exact.

1. Documents of equal sets form a class; classes are joined from here on.
2. A scan over the lower half of the hash range counts, per class, how many of its hashes other
   classes have too. A class that lacks too many has no partner and drops out.
3. For the others the length of every inverted list (the classes having a hash) is counted. A
   class's n - T + 1 shortest lists hold one that any partner's shortest lists hold too; hanging
   the classes of such lists on the list's smallest class gives coarse groups that no link leaves.
4. In each group (small ones share a task, large ones are cut into blocks whose pairs are tasks)
   DivideSkip answers every class's query: the short inverted lists are merged, classes that
   occur T - L times in them are probed by binary search in the L long lists, and those that reach
   the required overlap are links. Classes that earlier links connect need no probing, so a group
   of copies yields a spanning set of links, never all pairs.
5. Components of these links give every document the smallest document it reaches.

Hashes travel packed in arrays, one row per (task, hash range); before that each task merges
equal hashes, so a shingle that a third of all documents have adds one entry per task to the
range that gets it. The numbers of ranges, blocks and tasks follow the size of the data; packed
rows are never more than the entries in them.

Defined results: a null, empty or blank text has an empty set and only itself; a text under five
words has one shingle, its whole sequence; rows that repeat a doc_id are joined by their texts; a
row without doc_id gets the component of its class (null if that has none); an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import beside_ids, ship_by_value, small_batches, stash, table, texts_of
from tillroll.llm.components import connected_components

SHINGLE = 5
PERCENT = 75
#: Hashes below this are scanned in step 2: half of the range.
SCAN_BELOW = 1 << 63
#: Entries that a task packs, merges or searches at once, about.
ENTRIES = 400_000
#: Coarse groups of more hashes than this are cut into blocks.
GROUP_ENTRIES = 1_000_000
#: Sets whose ids are broadcast to pick their documents; more go through a shuffle.
BROADCAST_IDS = 2_000_000
#: Word hashes that a task remembers; beyond it the table starts anew.
REMEMBERED = 200_000
#: A long list is probed when merging it costs this many times its binary search, per candidate.
PROBE_COST = 4.0

# Odd multipliers of the five words of a shingle, and of the 64-bit finaliser.
WORD_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
FINAL_FACTORS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


class WordHashes(dict):
    """Remembers the hash of every word it was asked for."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def finalise(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(FINAL_FACTORS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(FINAL_FACTORS[1])
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, ASCII white space
    if not words:
        return np.zeros(0, dtype=np.uint64)
    a = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(a))
    x = np.full(len(a) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        x += a[j : len(a) - size + 1 + j] * np.uint64(WORD_FACTORS[j])
    return np.unique(finalise(x))


def set_keys(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit keys of a set; equal sets have equal keys."""
    total = s.sum(dtype=np.uint64), finalise(s ^ np.uint64(WORD_FACTORS[1])).sum(dtype=np.uint64)
    one, two = finalise(np.array(total, dtype=np.uint64) + np.uint64(len(s))).view(np.int64)
    return int(one), int(two)


DESCRIBED = "doc_id long, text_hash long, n_shingles long, scanned long, key long, key2 long"


def describer():
    """What DESCRIBED says about a text after its id and hash, for the texts of a batch."""
    hashes = WordHashes()

    def described(texts):
        sets = (shingle_set(text, hashes) for text in texts)
        return [(len(s), int(np.searchsorted(s, np.uint64(SCAN_BELOW))), *set_keys(s)) for s in sets]

    return described


def pack(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def unpack(parts, kind) -> np.ndarray:
    parts = list(parts)
    return np.frombuffer(b"".join(parts), dtype=kind) if parts else np.zeros(0, dtype=kind)


def in_ranges(sorted_hashes: np.ndarray, ranges: int, below: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, stop) of the equal hash ranges under ``below`` that occur: as many steps as
    that, however many ranges there are."""
    if ranges == 1:
        number = np.zeros(len(sorted_hashes), dtype=np.int64)
    else:
        number = np.minimum(sorted_hashes // np.uint64(below // ranges), np.uint64(ranges - 1)).astype(np.int64)
    starts = np.flatnonzero(changes(number)).tolist()
    for a, b in zip(starts, [*starts[1:], len(number)]):
        if a < b:
            yield int(number[a]), a, b


def group_sums(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Per element, the sum of ``values`` over its group; groups begin where ``first`` is true."""
    group = np.cumsum(first) - 1
    return np.bincount(group, weights=values)[group] if len(group) else np.zeros(0)


def changes(*arrays: np.ndarray) -> np.ndarray:
    """True where a sorted sequence differs from its predecessor in any of the arrays."""
    first = np.ones(len(arrays[0]), dtype=bool)
    first[1:] = False
    for a in arrays:
        first[1:] |= a[1:] != a[:-1]
    return first


SCAN = "range int, kind int, hashes binary, classes binary, known binary"


def scan_batches(ranges: int):
    """A mapInPandas function: (hash, class) entries of the scanned half, packed by hash range.

    A hash that several classes of the task have is credited to them here and sent once, marked
    as known to be shared (kind 0). Credits go along as rows of kind 1."""

    def scanned(batches):
        import pandas as pd

        hashes, held, size = WordHashes(), [], 0

        def packed():
            h = np.concatenate([s for s, _ in held])
            c = np.repeat(np.array([k for _, k in held], dtype=np.int64), [len(s) for s, _ in held])
            order = np.lexsort((c, h))
            h, c = h[order], c[order]
            new = changes(h, c)
            h, c = h[new], c[new]
            first = changes(h)
            shared = group_sums(first, np.ones(len(h))) > 1
            classes = np.unique(np.array([k for _, k in held], dtype=np.int64))
            credit = np.bincount(np.searchsorted(classes, c[shared]), minlength=len(classes))
            rows = [(int(classes[0]) % ranges, 1, b"", pack(classes), pack(credit.astype(np.int64)))]
            send = first | ~shared
            h, c, shared = h[send], c[send], shared[send]
            for i, a, b in in_ranges(h, ranges, SCAN_BELOW):
                rows.append((i, 0, pack(h[a:b]), pack(c[a:b]), pack(shared[a:b])))
            return pd.DataFrame(rows, columns=["range", "kind", "hashes", "classes", "known"])

        for batch in batches:
            for text in texts_of(batch["text"]):
                s = shingle_set(text, hashes)
                if len(s):
                    low = s[: np.searchsorted(s, np.uint64(SCAN_BELOW))]
                    held.append((low, set_keys(s)[0]))
                    size += len(low) + 1
            if size >= ENTRIES:
                yield packed()
                held, size = [], 0
        if held:
            yield packed()

    return scanned


CREDITS = "part int, classes binary, credits binary, seen binary"


def merge_scan(parts: int):
    """An applyInPandas function over the entries of one hash range: the hashes that other classes
    have too, counted per class, and the tasks that saw the class; packed by the class's part."""

    def merged(entries):
        import pandas as pd

        scanned = entries[entries["kind"] == 0]
        h, c = unpack(scanned["hashes"], np.uint64), unpack(scanned["classes"], np.int64)
        known = unpack(scanned["known"], bool)
        order = np.lexsort((c, h))
        h, c, known = h[order], c[order], known[order]
        first = changes(h) if len(h) else np.zeros(0, dtype=bool)
        several = group_sums(first, changes(h, c) if len(h) else first) > 1
        shared = several | (group_sums(first, known) > 0)
        found, credit = np.unique(c[shared & ~known], return_counts=True)
        told = entries[entries["kind"] == 1]
        classes, local = unpack(told["classes"], np.int64), unpack(told["known"], np.int64)
        keys = np.concatenate([found, classes])
        credits = np.concatenate([credit, local]).astype(np.int64)
        seen = np.concatenate([np.zeros(len(found)), np.ones(len(classes))]).astype(np.int64)
        part = keys % parts
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [
            (p, *(pack(x[order[a:b]]) for x in (keys, credits, seen))) for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b
        ]
        return pd.DataFrame(rows, columns=["part", "classes", "credits", "seen"])

    return merged


def sum_credits(part):
    """(key, credit, seen) of the classes of one part."""
    import pandas as pd

    keys, at = np.unique(unpack(part["classes"], np.int64), return_inverse=True)
    total = {n: np.zeros(len(keys), dtype=np.int64) for n in ("credits", "seen")}
    for name, sums in total.items():
        np.add.at(sums, at, unpack(part[name], np.int64))
    return pd.DataFrame({"key": keys, "credit": total["credits"], "seen": total["seen"]})


def set_batches(batches):
    """(key, n, hashes) of every document that has a shingle."""
    import pandas as pd

    hashes = WordHashes()
    for batch in batches:
        out = []
        for text in texts_of(batch["text"]):
            s = shingle_set(text, hashes)
            if len(s):
                out.append((set_keys(s)[0], len(s), pack(s)))
        yield pd.DataFrame(out, columns=["key", "n", "hashes"])


LENGTHS = "range int, block int, hashes binary, counts binary, least binary"
ANSWERS = "block int, hashes binary, counts binary, least binary"


def send_lengths(ranges: int):
    """Each hash of a block once, with the number and the smallest of its classes there."""

    def sent(block):
        import pandas as pd

        h = unpack(block["hashes"], np.uint64)
        c = np.repeat(block["key"].to_numpy(np.int64), block["n"].to_numpy(np.int64))
        order = np.lexsort((c, h))
        h, c = h[order], c[order]
        first = np.flatnonzero(changes(h))
        counts = np.diff(np.append(first, len(h))).astype(np.int64)
        h, c = h[first], c[first]
        number = int(block["block"].iloc[0])
        rows = [(i, number, pack(h[a:b]), pack(counts[a:b]), pack(c[a:b])) for i, a, b in in_ranges(h, ranges, 1 << 64)]
        return pd.DataFrame(rows, columns=["range", "block", "hashes", "counts", "least"])

    return sent


def merge_lengths(part):
    """List length and smallest class of the hashes of one range, told to every block that asked."""
    import pandas as pd

    sizes = [len(x) // 8 for x in part["hashes"]]
    h, counts = unpack(part["hashes"], np.uint64), unpack(part["counts"], np.int64)
    least = unpack(part["least"], np.int64)
    asked = np.repeat(part["block"].to_numpy(np.int64), sizes)
    order = np.lexsort((least, h))
    h, counts, least, asked = h[order], counts[order], least[order], asked[order]
    first = changes(h)
    total = group_sums(first, counts).astype(np.int64)
    leader = least[np.flatnonzero(first)][np.cumsum(first) - 1]
    rows = []
    several = total > 1
    h, total, leader, asked = h[several], total[several], leader[several], asked[several]
    order = np.argsort(asked, kind="stable")
    h, total, leader, asked = h[order], total[order], leader[order], asked[order]
    blocks, starts = np.unique(asked, return_index=True)
    for number, a, b in zip(blocks, starts, np.append(starts[1:], len(asked))):
        rows.append((int(number), pack(h[a:b]), pack(total[a:b]), pack(leader[a:b])))
    return pd.DataFrame(rows, columns=["block", "hashes", "counts", "least"])


def required(n):
    """The least overlap of a set of ``n`` with a partner that is no larger."""
    return (PERCENT * n + 99) // 100


def coarse_edges(block, answers):
    """(class, smallest class of the list) for the shortest n - T + 1 lists of every class."""
    import pandas as pd

    h = unpack(answers["hashes"], np.uint64)
    counts, least = unpack(answers["counts"], np.int64), unpack(answers["least"], np.int64)
    order = np.argsort(h, kind="stable")
    h, counts, least = h[order], counts[order], least[order]
    a, b = [], []
    for key, n, packed in zip(block["key"], block["n"], block["hashes"]):
        s = np.frombuffer(packed, dtype=np.uint64)
        at = np.searchsorted(h, s)
        at = at[np.take(h, np.minimum(at, len(h) - 1)) == s] if len(h) else at[:0]
        alone = n - len(at)  # lists of length one come first in the order
        short = int(n) - int(required(n)) + 1 - alone
        if short > 0 and len(at):
            at = at[np.lexsort((h[at], counts[at]))[:short]]
            leaders = np.unique(least[at])
            leaders = leaders[leaders != key]
            a.append(np.full(len(leaders), key, dtype=np.int64))
            b.append(leaders)
    empty = [np.zeros(0, dtype=np.int64)]
    return pd.DataFrame({"a": np.concatenate(a or empty), "b": np.concatenate(b or empty)}).drop_duplicates()


def spanning_links(keys: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(class, smallest class linked to it) over the classes of one task, by DivideSkip."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    by_size = np.lexsort((keys, sizes))
    keys, sizes, sets = keys[by_size], sizes[by_size], [sets[i] for i in by_size]
    docs = np.int64(len(sets))
    _, tokens = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(docs), sizes)
    postings = np.sort(tokens.astype(np.int64) * docs + owner)  # list after list, each by size of its sets
    stops = np.cumsum(sizes)
    label = np.arange(docs)

    def overlap(candidates: np.ndarray, count: np.ndarray, long_lists: np.ndarray) -> np.ndarray:
        """Merged occurrences plus binary probes of the long lists."""
        total = count.copy()
        step = max(1, 500_000 // max(1, len(long_lists)))
        for a in range(0, len(candidates), step):
            wanted = long_lists[:, None] * docs + candidates[None, a : a + step]
            at = np.minimum(np.searchsorted(postings, wanted), len(postings) - 1)
            total[a : a + step] += (postings[at] == wanted).sum(axis=0)
        return total

    for q in range(1, int(docs)):
        n = int(sizes[q])
        need = int(required(n))
        least = int(np.searchsorted(sizes[:q], -(-PERCENT * n // 100)))
        if least == q:
            continue
        own = tokens[stops[q] - n : stops[q]].astype(np.int64)
        begin = np.searchsorted(postings, own * docs + least)
        length = np.searchsorted(postings, own * docs + q) - begin
        held = length > 0
        if held.sum() < need:
            continue
        own, begin, length = own[held], begin[held], length[held]
        order = np.argsort(length, kind="stable")
        own, begin, length = own[order], begin[order], length[order]
        # the longest lists are probed, as many as merging would cost more, T - 1 at most
        longest = max(2.0, float(length[-1]))
        long = min(need - 1, int(need / (PROBE_COST * np.log2(longest) / longest + 1)))
        short = len(own) - long
        total = int(length[:short].sum())
        starts = np.repeat(begin[:short] - np.append(0, np.cumsum(length[:short])[:-1]), length[:short])
        merged = postings[starts + np.arange(total)] % docs
        count = np.bincount(merged - least, minlength=q - least)
        candidates = np.flatnonzero(count >= need - long)
        count = count[candidates]
        candidates = candidates + least
        for best_only in (True, False):  # first the best candidate of each component, then all others
            other = label[candidates] != label[q]
            candidates, count = candidates[other], count[other]
            if not len(candidates):
                break
            if best_only:
                by_label = np.lexsort((-count, label[candidates]))
                pick = by_label[changes(label[candidates][by_label])]
            else:
                pick = np.arange(len(candidates))
            both = overlap(candidates[pick], count[pick], own[short:])
            linked = 100 * both >= PERCENT * (n + sizes[candidates[pick]] - both)
            for d in candidates[pick[linked]]:
                if label[d] != label[q]:
                    label[label == label[d]] = label[q]
    smallest = np.full(int(docs), np.iinfo(np.int64).max)
    np.minimum.at(smallest, label, keys)
    return [(int(k), int(s)) for k, s in zip(keys, smallest[label]) if k != s]


def search_task(part):
    """An applyInPandas function over the classes of one task."""
    import pandas as pd

    part = part.drop_duplicates("key")
    sets = [np.frombuffer(x, dtype=np.uint64) for x in part["hashes"]]
    return pd.DataFrame(spanning_links(part["key"].to_numpy(np.int64), sets), columns=["a", "b"], dtype=np.int64)


def share(total: int | None, each: int) -> int:
    return max(1, -(-(total or 0) // each))


def partner_candidates(docs: DataFrame, described: DataFrame) -> DataFrame:
    """key, n, hashes of the classes that the scan leaves (step 2), each once."""
    classes = stash(
        described.filter("n_shingles > 0")
        .groupBy("key", "key2", "n_shingles", "scanned")
        # one row whose text has the set: the smallest id, of a class without ids any of its texts
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("class_row")),
        "join-classes",
    )
    ranges = share(classes.agg(F.sum("scanned")).first()[0], ENTRIES)
    credits = (
        docs.select("text")
        .mapInPandas(scan_batches(ranges), SCAN)
        .groupBy("range")
        .applyInPandas(merge_scan(ranges), CREDITS)
        .groupBy("part")
        .applyInPandas(sum_credits, "key long, credit long, seen long")
        .withColumnRenamed("key", "credit_key")
    )
    lacking = F.col("n_shingles") - F.floor((F.lit(PERCENT) * F.col("n_shingles") + 99) / 100)
    left = stash(
        classes.join(credits, F.col("key") == F.col("credit_key"))
        .filter(F.col("credit") >= (F.col("scanned") - lacking) * F.col("seen"))
        .select(F.col("key").alias("left_key"), "class_row.doc_id", "class_row.text_hash"),
        "join-left",
    )
    rows = left.select(F.col("doc_id").alias("left_doc"), F.col("text_hash").alias("left_hash")).distinct()
    if left.count() <= BROADCAST_IDS:
        rows = F.broadcast(rows)
    return (
        docs.select("doc_id", "text")
        .join(rows, F.col("doc_id").eqNullSafe(F.col("left_doc")) & (F.xxhash64("text") == F.col("left_hash")), "left_semi")
        .select("text")
        .mapInPandas(set_batches, "key long, n long, hashes binary")
        .join(left.select("left_key"), F.col("key") == F.col("left_key"), "left_semi")
        .dropDuplicates(["key"])
    )


def link_components(docs: DataFrame, described: DataFrame) -> DataFrame:
    """(node, component) of the classes that have a link."""
    sets = stash(partner_candidates(docs, described), "join-sets")
    total = sets.agg(F.sum("n")).first()[0]
    blocks = ranges = share(total, ENTRIES)
    blocked = sets.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    answers = (
        blocked.groupBy("block")
        .applyInPandas(send_lengths(ranges), LENGTHS)
        .groupBy("range")
        .applyInPandas(merge_lengths, ANSWERS)
    )
    edges = (
        blocked.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(coarse_edges, "a long, b long")
    )
    groups = connected_components(edges).withColumnRenamed("component", "group")
    members = stash(
        sets.join(groups, F.col("key") == F.col("node")).select("key", "n", "hashes", "group"), "join-members"
    )
    tasks = members.groupBy(F.col("group").alias("of")).agg(
        F.ceil(F.sum("n") / F.lit(GROUP_ENTRIES)).cast("int").alias("cuts")
    )
    small = F.col("cuts") == 1
    own = F.pmod(F.xxhash64("key"), F.col("cuts").cast("long")).cast("int")
    dealt = (
        members.join(tasks, F.col("group") == F.col("of"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .select(
            "key",
            "hashes",
            F.when(small, F.pmod(F.xxhash64("group"), F.lit(share(total, ENTRIES)))).otherwise(F.col("group")).alias("task"),
            F.when(small, -1).otherwise(F.least("own", "other")).alias("one"),
            F.when(small, -1).otherwise(F.greatest("own", "other")).alias("two"),
        )
    )
    links = dealt.groupBy("task", "one", "two").applyInPandas(search_task, "a long, b long")
    return connected_components(links)


def label_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component and component_id of every row.

    ``component`` numbers the component itself (null for rows without words), also where ids are
    null or stand for several texts; ``component_id`` is its smallest doc_id."""
    spark = docs.sparkSession
    ship_by_value(__name__)
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    described = stash(
        docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
            beside_ids(describer, DESCRIBED, kept=2), DESCRIBED
        ),
        "join-docs",
    )
    labels = link_components(docs, described)
    classed = (
        described.filter("n_shingles > 0")
        .groupBy("key", "key2", "n_shingles")
        .agg(F.min("doc_id").alias("class_doc"))
        .join(labels, F.col("key") == F.col("node"), "left")
        .withColumn("component", F.coalesce("component", "key"))
        .select(F.col("key").alias("k"), F.col("key2").alias("k2"), "class_doc", "component")
    )
    least = classed.groupBy(F.col("component").alias("c")).agg(F.min("class_doc").alias("component_id"))
    labelled = classed.join(least, F.col("component") == F.col("c")).select("k", "k2", "component", "component_id")
    same = (F.col("key") == F.col("k")) & (F.col("key2") == F.col("k2")) & (F.col("n_shingles") > 0)
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return described.join(labelled, same, "left").select(
        "doc_id", "text_hash", "n_shingles", "component", own.alias("component_id")
    )


def join_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return label_documents(docs).select("doc_id", "n_shingles", "component_id")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and component."""
    return join_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLES: dict[str, str] = {}

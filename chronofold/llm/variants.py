"""Spelling variants: words of a corpus at distance one, grouped under their common forms.

The vocabulary is kept as tries that are dealt out by prefix.  Two words at
distance one share either a first part or a last part that is about half as
long as the longer of them, so each word goes into a trie of words with the same
first part and into a trie, read from behind, of words with the same last part.
In each trie active-node sets go down from the root: the nodes one edit away
from a node are those of its parent one letter on, the parent, the siblings and
the children.  Where two words end on active nodes they are a pair.

Prefixes with more than SHARD words are split by the letters that follow.  Pairs
that the split parts differ in exactly those letters, so they have the rest in
common and meet by it, at most one word for each letter.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import join_small, partitions_for, stage_table

#: Letters of a word.
RUN = "[a-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a letter.
NOISE = 97
#: Words of one trie, at most.
SHARD = 20_000
#: Pairs that Python hands over at a time.
PAIRS = 20_000


def vocabulary(docs: DataFrame, least_chars: int = 5, least_count: int = 3, noise: int = NOISE) -> DataFrame:
    """Words of all texts with their number of occurrences: word, n.

    Runs of letters are lower-cased (A to Z only).  Where the checksum of
    ``<doc_id>:<run>`` is divisible by ``noise`` the letter at checksum modulo
    length goes.  A null text has no words; a null id counts as an empty one;
    repeated rows count again; texts of any length are taken whole.
    """
    text = F.translate(F.col("text"), _UPPER, _LOWER)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(key.alias("k"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))
    summed = F.crc32(F.concat("k", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run"))
    words = runs.withColumn("h", summed).select(word.alias("word")).where(F.length("word") >= least_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def build_trie(words: list[str], start: int) -> tuple[list[dict[str, int]], list[int], list[str | None]]:
    """Children by letter, the word that ends at a node (or -1), and the rest of a node's only word (or None).

    All words have their first ``start`` letters in common.
    """
    kids: list[dict[str, int]] = [{}]
    ends, rest = [-1], [None]
    todo = [(0, range(len(words)), start)]
    while todo:
        node, members, depth = todo.pop()
        if len(members) == 1 and node:
            ends[node], rest[node] = members[0], words[members[0]][depth:]
            continue
        groups: dict[str, list[int]] = {}
        for i in members:
            if len(words[i]) <= depth:
                ends[node] = i
            else:
                groups.setdefault(words[i][depth], []).append(i)
        for letter, group in groups.items():
            kids[node][letter] = len(kids)
            todo.append((len(kids), group, depth + 1))
            kids.append({})
            ends.append(-1)
            rest.append(None)
    return kids, ends, rest


def near_in_trie(words: list[str], start: int) -> list[tuple[int, int]]:
    """Pairs of places of different words at distance one, each pair both ways round.

    A place of the trie is a node, or a node and a number of letters into the
    rest of its only word.
    """
    kids, ends, rest = build_trie(words, start)

    def follow(node: int, off: int, letters: str) -> int:
        for i, letter in enumerate(letters):
            if rest[node] is not None:
                return ends[node] if rest[node][off:] == letters[i:] else -1
            node = kids[node].get(letter, -1)
            if node < 0:
                return -1
        return ends[node] if rest[node] is None or off == len(rest[node]) else -1

    out = []
    todo = [(0, {(k, 0) for k in kids[0].values()})]
    while todo:
        node, active = todo.pop()
        if ends[node] >= 0:  # a word ends here, or has only its rest to go
            for v, off in active:
                other = follow(v, off, rest[node] or "")
                if other >= 0:
                    out.append((ends[node], other))
        for letter, kid in kids[node].items():
            near = {(k, 0) for k in kids[node].values() if k != kid}
            near.add((node, 0))
            near.update((k, 0) for k in kids[kid].values())
            for v, off in active:
                if rest[v] is None:
                    if letter in kids[v]:
                        near.add((kids[v][letter], 0))
                elif off < len(rest[v]) and rest[v][off] == letter:
                    near.add((v, off + 1))
            todo.append((kid, near))
    return out


def _pairs_of_shard(shard: list[tuple[str, int]], longest: int, back: bool, start: int):
    half = longest // 2
    spelled = [w[::-1] if back else w for w, _ in shard]
    for i, j in near_in_trie(spelled, start):
        (a, _), (b, n) = shard[i], shard[j]
        if max(len(a), len(b)) == longest and not (back and a[:half] == b[:half]):
            yield a, b, n


_PAIR = "word string, near string, near_n long"


def _near(batches):
    """Rows of one shard follow each other; each shard is joined with itself."""
    held, shard = None, []
    out: tuple[list, list, list] = ([], [], [])

    def ready():
        made = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], ["word", "near", "near_n"])
        for x in out:
            x.clear()
        return made

    def close():
        if len(shard) > 1:
            for row in _pairs_of_shard(shard, *held[:3]):
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                if len(out[0]) >= PAIRS:
                    yield ready()

    for batch in batches:
        for longest, back, start, key, word, n in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            if (longest, back, start, key) != held:
                yield from close()
                held, shard = (longest, back, start, key), []
            shard.append((word, n))
    yield from close()
    yield ready()


_SHARD_KEY = ["longest", "back", "start", "key"]


def _deal(words: DataFrame) -> DataFrame:
    """Each word in its four shards: as the longer or the shorter word of a pair, from the front and from behind."""
    size = F.length("word")
    half = (F.col("longest") / 2).cast("int")
    start = F.when(F.col("back"), F.col("longest") - half).otherwise(half)
    dealt = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longest")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    return dealt.withColumn("start", start).withColumn("key", _spelled().substr(F.lit(1), F.col("start"))).select(*_SHARD_KEY, "word", "n")


def _spelled():
    return F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))


def _common(a: str, b: str):
    """Letters that two strings begin with in common."""
    shorter = F.least(F.length(a), F.length(b))
    place = F.sequence(F.lit(0), shorter)  # never the empty case, which would count downwards
    differs = F.filter(place, lambda i: (i == shorter) | (F.col(a).substr(i + 1, F.lit(1)) != F.col(b).substr(i + 1, F.lit(1))))
    return F.array_min(differs).cast("int")


def _across(rows: DataFrame) -> DataFrame:
    """Pairs that differ in the letter before ``start``, where their shard was split, and nowhere else."""
    spelled, at = F.col("s"), F.col("start")
    long = F.length("word") == F.col("longest")
    rest = F.when(long, F.concat(spelled.substr(F.lit(1), at - 1), spelled.substr(at + 1, F.length("s")))).otherwise(spelled)
    letter = spelled.substr(at, F.lit(1))
    rows = rows.withColumn("s", _spelled()).where(~long | (F.length("word") >= at)).select("longest", "back", "start", rest.alias("rest"), F.struct("word", "n", letter.alias("c"), long.alias("long")).alias("w"))
    met = rows.groupBy("longest", "back", "start", "rest").agg(F.collect_list("w").alias("ws")).where(F.size("ws") > 1)  # one word for each letter, and one without
    pairs = met.select("longest", "back", F.explode("ws").alias("a"), "ws").select("longest", "back", "a", F.explode("ws").alias("b"))
    half = (F.col("longest") / 2).cast("int")
    told = F.col("back") & (F.col("a.word").substr(F.lit(1), half) == F.col("b.word").substr(F.lit(1), half))
    return pairs.where((F.col("a.c") != F.col("b.c")) & (F.col("a.long") | F.col("b.long")) & ~told).select(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))


def near_pairs(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """All pairs of different words at distance one, both ways round: word, near, near_n.

    ``words`` has each word once, none of them empty or null, with its number n.
    """
    dealt, found = _deal(words), None
    while True:
        spelled = dealt.withColumn("s", _spelled())
        sizes = spelled.groupBy(*_SHARD_KEY).agg(F.count("*").alias("size"), F.min("s").alias("least"), F.max("s").alias("most"))
        large = stage_table(sizes.where(F.col("size") > shard).select(*_SHARD_KEY, (_common("least", "most") + 1).alias("next")), "large-shards")
        if large.isEmpty():
            break
        dealt = join_small(dealt, large, _SHARD_KEY, "left")
        moved = dealt.where("next IS NOT NULL").drop("start", "key").withColumnRenamed("next", "start")
        split = moved.withColumn("key", _spelled().substr(F.lit(1), F.col("start")))
        across = _across(moved)
        found = across if found is None else found.unionByName(across)
        dealt = stage_table(dealt.where("next IS NULL").drop("next").unionByName(split.select(*_SHARD_KEY, "word", "n")), "shards")
    together = dealt.repartition(partitions_for(words, 2 << 20), *_SHARD_KEY).sortWithinPartitions(*_SHARD_KEY)
    pairs = together.mapInArrow(_near, _PAIR)
    return pairs if found is None else pairs.unionByName(found)


def roots(linked: DataFrame) -> DataFrame:
    """The last form that following ``form`` from each word leads to: word, root.

    Links lead to words at least twice as frequent, so there are no rings, and
    each step doubles how far a row looks.
    """
    reached = stage_table(linked.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("far"))
        nearer = reached.join(onward, "root", "left")
        stepped = stage_table(nearer.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        reached = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return reached


def group_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """Each word's commonest near word, if that is at least twice as frequent, and where following such forms ends.

    Ties between near words go to the smallest in code-point order.  A word
    without a form is its own root; an empty vocabulary gives no rows.
    """
    words = stage_table(words.select("word", "n"), "vocabulary")
    best = near_pairs(words, shard).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    told = words.join(best, "word", "left")
    fits = -F.col("b.m") >= 2 * F.col("n")
    told = stage_table(told.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("b.near")).alias("form"), F.when(fits, -F.col("b.m")).alias("form_n")), "near-words")
    ends = roots(told.where("form IS NOT NULL"))
    out = told.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group_variants(docs: DataFrame) -> DataFrame:
    """Words of all texts, each with the form that it is a variant of.  Only ``doc_id`` and ``text`` are read, whatever other columns there are."""
    return group_words(vocabulary(docs.select("doc_id", "text")))

r"""Groups of spelling variants: words one edit apart, each led to its commonest form.

Method: broadcast compact trie shards. The vocabulary is sorted by ranges and cut
into shards of at most ``SHARD`` words; each becomes a trie, packed as one byte
of label and one of fan-out a node and eight of count a word. Shards are
broadcast in waves of at most ``WAVE`` bytes (the bound of what the driver and a
task hold at a time), and every word's distance-one Levenshtein automaton is
intersected with every shard depth-first: a state is (word, node, position,
edit used or not), chunks of states wait on a stack and the deepest goes on
first. A shard of other beginnings ends at its root. Accepting states are the
neighbours; each is reached by one way only, as a letter is inserted after a run
of its like and deleted at the run's end. A word's neighbours are summed where
they are found, as their number and the best form, so no pair leaves a task;
the waves' sums meet by word.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, so a code point fits a
byte. A form is followed to the last by pointer jumping: counts double at each
step, so a chain of forms has no circle.

Defined results: null and empty texts hold no words; a null doc_id is written as
nothing before the colon; repeated rows count as often as they stand; a word
that loses all its letters is none; an empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.llm.common import Scratch, table

LETTERS = "[A-Za-zÀ-ÿ]+"
TYPO = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
SHARD, WAVE = 50_000, 32 << 20
STATES = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_letters(c: Column) -> Column:
    return F.when(c.rlike("[A-Z]"), F.translate(c, UPPER, LOWER)).otherwise(c)


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int = TYPO) -> DataFrame:
    """(word, n) of the whole texts, one occurrence in ``typo`` misspelt by a rule."""
    runs = docs.select(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(docs["text"], F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select("id", small_letters(F.col("run")).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("h") % typo == 0, cut).otherwise(F.col("run")).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.where((F.length("word") >= least_length) & (F.col("n") >= least_count))


class Trie:
    """Words of one shard. Nodes are numbered level by level, so that edge k leads to node k + 1."""

    def __init__(self, label: np.ndarray, fanout: np.ndarray, place: np.ndarray, n: np.ndarray):
        self.label, self.n = label, n
        self.first = np.concatenate([[0], np.cumsum(fanout, dtype=np.int64)])
        self.parent = np.concatenate([[0], np.repeat(np.arange(len(fanout)), fanout)])
        self.edges = self.parent[1:] << 8 | label  # ascending
        self.word_at = np.full(len(fanout), -1, dtype=np.int64)
        self.word_at[place] = np.arange(len(place))
        self.place = place

    @classmethod
    def of(cls, words: list[str], n: np.ndarray) -> Trie:
        """``words`` sorted and distinct."""
        codes = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
        size = np.array([len(w) for w in words])
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        active, node = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
        place = np.zeros(len(words), dtype=np.int64)
        labels, parents, made, depth = [], [], 1, 0
        while True:
            ends = size[active] == depth
            place[active[ends]] = node[ends]
            active, node = active[~ends], node[~ends]
            if not len(active):
                break
            code = codes[start[active] + depth]
            new = np.ones(len(active), dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (code[1:] != code[:-1])
            labels.append(code[new])
            parents.append(node[new])
            node = made + np.cumsum(new) - 1
            made += int(new.sum())
            depth += 1
        fanout = np.bincount(np.concatenate(parents), minlength=made) if parents else np.zeros(1, dtype=np.int64)
        return cls(np.concatenate(labels) if labels else np.zeros(0, dtype=np.uint8), fanout, place, np.asarray(n, dtype=np.int64))

    def packed(self) -> bytes:
        sizes = np.array([len(self.label), len(self.place)], dtype="<i8")
        return b"".join([sizes.tobytes(), self.label.tobytes(), np.diff(self.first).astype(np.uint8).tobytes(), self.place.astype("<i4").tobytes(), self.n.astype("<i8").tobytes()])

    @classmethod
    def unpacked(cls, data: bytes) -> Trie:
        edges, words = map(int, np.frombuffer(data, "<i8", 2))
        at = 16
        label = np.frombuffer(data, np.uint8, edges, at)
        fanout = np.frombuffer(data, np.uint8, edges + 1, at + edges)
        at += 2 * edges + 1
        return cls(label, fanout, np.frombuffer(data, "<i4", words, at).astype(np.int64), np.frombuffer(data, "<i8", words, at + 4 * words))

    def child(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node below by a letter, -1 if none."""
        if not len(self.edges):
            return np.full(len(node), -1)
        key = node << 8 | code
        k = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[k] == key, k + 1, -1)

    def word(self, i: np.ndarray) -> list[str]:
        """Words by their number, read from the leaves up."""
        node = self.place[i]
        letters: list[bytearray] = [bytearray() for _ in i]
        open_words = np.nonzero(node)[0]
        while len(open_words):
            for j, code in zip(open_words, self.label[node[open_words] - 1], strict=True):
                letters[j].append(code)
            node[open_words] = self.parent[node[open_words]]
            open_words = open_words[node[open_words] > 0]
        return [bytes(reversed(b)).decode("latin-1") for b in letters]


class Block:
    """Words to be looked up, as one array of codes."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.codes = np.concatenate([np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8), [0]]).astype(np.int64)

    def code(self, w: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The letter at a position, 0 at the end."""
        inside = pos < self.size[w]
        return np.where(inside, self.codes[np.where(inside, self.start[w] + pos, 0)], 0)


def accepted(trie: Trie, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word of the block, word of the trie) of all pairs one edit apart, each once, in chunks."""
    n = len(block.size)
    stack = [(np.arange(i, min(n, i + STATES)), np.zeros(min(n, i + STATES) - i, dtype=np.int64), np.zeros(min(n, i + STATES) - i, dtype=np.int64), False) for i in range(0, n, STATES)]
    while stack:
        w, node, pos, edited = stack.pop()
        if edited:  # the rest must match
            while len(w):
                done = pos == block.size[w]
                if done.any():
                    hit = trie.word_at[node[done]]
                    yield w[done][hit >= 0], hit[hit >= 0]
                    w, node, pos = w[~done], node[~done], pos[~done]
                node = trie.child(node, block.code(w, pos))
                go = node >= 0
                w, node, pos = w[go], node[go], pos[go] + 1
            continue
        more = pos < block.size[w]
        here = block.code(w, pos)
        same = np.where(more, trie.child(node, here), -1)
        drop = more & (here != block.code(w, pos + 1))
        next_states = [(w[drop], node[drop], pos[drop] + 1)]
        fan = trie.first[node + 1] - trie.first[node]
        src = np.repeat(np.arange(len(w)), fan)
        edge = np.arange(len(src)) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(trie.first[node], fan)
        other = trie.label[edge] != here[src]
        src, below = src[other], edge[other] + 1
        next_states.append((w[src], below, pos[src]))
        sub = more[src]
        next_states.append((w[src][sub], below[sub], pos[src][sub] + 1))
        go = same >= 0
        if go.any():
            stack.append((w[go], same[go], pos[go] + 1, False))
        for a, b, c in next_states:
            stack.extend((a[i : i + STATES], b[i : i + STATES], c[i : i + STATES], True) for i in range(0, len(a), STATES))


def shards(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """(part, trie, bytes): packed tries over ranges of sorted words."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def out() -> pd.DataFrame:
            rows = pd.concat(held)
            data = Trie.of(list(rows["word"]), rows["n"].to_numpy()).packed()
            held.clear()
            return pd.DataFrame({"trie": [data], "bytes": [len(data)]})

        for rows in batches:
            while len(rows):
                room = shard - sum(map(len, held))
                held.append(rows[:room])
                rows = rows[room:]
                if sum(map(len, held)) == shard:
                    yield out()
        if held:
            yield out()

    return words.mapInPandas(pack, "trie binary, bytes long").withColumn("part", F.monotonically_increasing_id())


def near(words: DataFrame, tries) -> DataFrame:
    """(word, n_near, best_n, best): sums over the neighbours in the broadcast ``tries``, words without any left out."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = [Trie.unpacked(data) for data in tries.value]
        for rows in batches:
            block, n = Block(list(rows["word"])), len(rows)
            count, most = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            best = np.full(n, None, dtype=object)
            for trie in opened:
                pairs = list(accepted(trie, block))
                if not pairs:
                    continue
                w, x = (np.concatenate(side) for side in zip(*pairs, strict=True))
                count += np.bincount(w, minlength=n)
                order = np.lexsort((x, -trie.n[x], w))  # words of a shard are numbered in code-point order
                first = np.ones(len(w), dtype=bool)
                first[1:] = w[order][1:] != w[order][:-1]
                w, x = w[order][first], x[order][first]
                found = trie.word(x)
                for i, c, form in zip(w, trie.n[x], found, strict=True):
                    if c > most[i] or c == most[i] and form < best[i]:
                        most[i], best[i] = c, form
            hit = count > 0
            yield pd.DataFrame({"word": rows["word"][hit], "n_near": count[hit], "best_n": most[hit], "best": best[hit]})

    return words.select("word").mapInPandas(look, "word string, n_near long, best_n long, best string")


def followed(scratch: Scratch, forms: DataFrame) -> DataFrame:
    """(word, root) of words with a form, by pointer jumping: each round doubles the length of the way seen."""
    ways = scratch.keep(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        ahead = ways.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        longer = scratch.keep(ways.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "ways")
        scratch.drop(ways)
        ways = longer
        if not ways.where("moved").limit(1).count():
            return ways.select("word", "root")


def variants(spark: SparkSession, words: DataFrame, shard: int = SHARD, wave: int = WAVE) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of ``words`` (word, n): distinct words of U+0000 to U+00FF."""
    scratch = Scratch(spark, "spelling")
    words = scratch.keep(words.select("word", F.col("n").cast("long").alias("n")), "counts")
    rows = words.count()
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // 20_000))
    ordered = scratch.keep(words.repartitionByRange(blocks, "word").sortWithinPartitions("word"), "words")
    # Few large ranges make few tries; their readers cut them again, so no trie is larger than a shard.
    coarse = words.repartitionByRange(max(1, -(-rows // shard)), "word").sortWithinPartitions("word")
    packed = scratch.keep(shards(coarse, shard), "tries")
    sums, held, size = [], [], 0
    index = packed.select("part", "bytes").orderBy("part").toLocalIterator()  # two numbers a shard
    waves: list[list[int]] = [[]]
    for row in index:
        if waves[-1] and size + row["bytes"] > wave:
            waves.append([])
            size = 0
        waves[-1].append(row["part"])
        size += row["bytes"]
    for parts in waves:
        held = [row["trie"] for row in packed.where(F.col("part").isin(parts)).collect()] if parts else []
        tries = spark.sparkContext.broadcast(held)
        sums.append(scratch.keep(near(ordered, tries), "near"))
        tries.destroy()
    found = sums[0]
    for more in sums[1:]:
        found = found.unionByName(more)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    known = words.join(found, "word", "left")
    led = F.coalesce(-F.col("b.m") >= 2 * F.col("n"), F.lit(False))
    known = scratch.keep(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("b.best")).alias("form"), F.when(led, -F.col("b.m")).alias("form_n")), "forms")
    roots = followed(scratch, known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with its near words' number, its form and the last form behind it."""
    return variants(spark, vocabulary(table(spark, sf_dir, "documents")))

"""Spelling variants: words one slip apart, found by minimal acyclic automata that run forwards and backwards.

If two words differ by one inserted, deleted or replaced code point, the slip lies in one half of a word and the other half is the same in
both. So each word's first half is matched exactly in an automaton of the words, and the rest completed with one error; and the same from the
other end, in an automaton of the reversed words. Each automaton numbers its words by perfect hashing (a transition knows how many words come
before those behind it), so a match is a number, and numbers are what is deduplicated.

Words meet in cells: a word of the dictionary goes to the cell of its length and its beginning, a word that searches to those of the lengths
within one of its own. The beginning is as long as the half that any of these match exactly. Cells are dealt over shards of bounded size; a
beginning that too many words share is cut into blocks, and every block of the dictionary meets every block of the searching words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, map_arrow, ship, stage_table, text_groups

#: Words have at least so many code points and occurrences.
LEAST_LENGTH, LEAST_COUNT = 5, 3

#: A word's form has at least so many times its occurrences.
LEAD = 2

#: Words of one beginning that a cell's dictionary holds, and rows that a shard gets on average.
CELL, SHARD = 50_000, 100_000

#: Different words that a task counts before it sends them on.
HELD = 400_000


class Automaton:
    """The minimal acyclic automaton of ascending distinct words; the word of number i is the i-th of them."""

    def __init__(self, words: list[str]):
        self.steps: list[dict[str, tuple[int, int]]] = []  # by state: character -> (state, words before those behind it)
        self.final: list[bool] = []
        self._counts: list[int] = []
        self._register: dict[tuple, int] = {}
        open_edges: list[dict[str, int]] = [{}]
        open_final = [False]
        before = ""
        for word in words:
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            self._settle(open_edges, open_final, before, same)
            for _ in range(same, len(word)):
                open_edges.append({})
                open_final.append(False)
            open_final[-1] = True
            before = word
        self._settle(open_edges, open_final, before, 0)
        self.root = self._state(open_edges[0], open_final[0])
        del self._register

    def _settle(self, edges: list[dict[str, int]], final: list[bool], word: str, depth: int) -> None:
        """Makes states of the open ones beyond depth, from the word's end."""
        for i in range(len(word), depth, -1):
            edges[i - 1][word[i - 1]] = self._state(edges.pop(), final.pop())

    def _state(self, edges: dict[str, int], final: bool) -> int:
        key = (final, *edges.items())
        state = self._register.get(key)
        if state is None:
            state = self._register[key] = len(self.steps)
            steps, count = {}, int(final)
            for c, target in edges.items():
                steps[c] = (target, count)
                count += self._counts[target]
            self.steps.append(steps)
            self.final.append(final)
            self._counts.append(count)
        return state

    def _rest(self, state: int, number: int, rest: str) -> int:
        """The number of the word that goes on with rest, or -1."""
        steps = self.steps
        for c in rest:
            step = steps[state].get(c)
            if step is None:
                return -1
            state = step[0]
            number += step[1]
        return number if self.final[state] else -1

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with the first `exact` characters of word and differ from it by one slip behind them."""
        state, number, steps, rest = self.root, 0, self.steps, self._rest
        for c in word[:exact]:
            step = steps[state].get(c)
            if step is None:
                return set()
            state = step[0]
            number += step[1]
        found = set()
        for i in range(exact, len(word) + 1):
            here, after = word[i:], word[i + 1 :]
            own = word[i] if here else None
            for c, (target, ahead) in steps[state].items():
                found.add(rest(target, number + ahead, here))  # one more in the other word
                if own is not None and c != own:
                    found.add(rest(target, number + ahead, after))
            if own is None:
                break
            found.add(rest(state, number, after))  # one less
            step = steps[state].get(own)
            if step is None:
                break
            state = step[0]
            number += step[1]
        found.discard(-1)
        return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slip: int | None = None) -> DataFrame:
    """(word, n long): the words of all texts with at least LEAST_LENGTH code points and LEAST_COUNT occurrences.

    A text's runs are the maximal ones of [A-Za-z\\u00C0-\\u00FF], A-Z lower-cased; null text has none. With slip, slips of the pen are put in:
    where it divides the crc32 of "<id>:<run>" (a null id: "null"), the code point at that number modulo the run's length is left out; a word is
    what remains. Repeated rows count each.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LENGTH},}}")  # shorter ones make no word

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch, texts in text_groups(batches):
            for key, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                own = Counter(runs.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if slip is not None:
                    begin = zlib.crc32(f"{'null' if key is None else key}:".encode())
                    wrong = [(r, h) for r in own if (h := zlib.crc32(r.encode(), begin)) % slip == 0]
                    put = []
                    for r, h in wrong:
                        at = h % len(r)
                        put.append((r[:at] + r[at + 1 :], own.pop(r)))
                    for r, n in put:
                        if len(r) >= LEAST_LENGTH:
                            own[r] += n
                held.update(own)
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = map_arrow(rows, count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of different words of vocabulary(word, n) that one slip makes of each other, each once.

    Words are distinct, not null and have at least LEAST_LENGTH code points.
    """
    spark = vocabulary.sparkSession
    ship(spark)
    ways = vocabulary.select("n", F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("s")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("s")))).alias("e"))
    ways = ways.select("n", "e.way", "e.s", F.char_length("e.s").alias("length"))
    # The half that a word of any length within one of this matches exactly is at least as long.
    begins = lambda length: F.greatest(F.lit(2), F.expr(f"({length} - 1) div 2")).cast("int")
    entries = ways.select("way", "s", "n", F.lit(True).alias("entry"), F.struct("length", F.col("s").substr(F.lit(1), begins("length")).alias("begin")).alias("key"))
    asking = ways.select("way", "s", "n", "length", F.explode(F.array(F.col("length") - 1, F.col("length"), F.col("length") + 1)).alias("other")).where(F.col("other") >= LEAST_LENGTH)
    asking = asking.select("way", "s", "n", F.lit(False).alias("entry"), F.struct(F.col("other").alias("length"), F.col("s").substr(F.lit(1), begins("other")).alias("begin")).alias("key"))

    total = vocabulary.count()
    # Fewer than 2 * HOT beginnings have more than 1 / HOT of the words of a direction, so their table can be broadcast.
    large = entries.groupBy("way", "key").count().where(F.col("count") > max(CELL, total // HOT))
    large = large.select(F.col("way").alias("__way"), F.col("key").alias("__key"), F.ceil(F.col("count") / CELL).cast("int").alias("blocks"))
    rows = entries.unionByName(asking)
    rows = rows.join(F.broadcast(large), (F.col("way") == F.col("__way")) & (F.col("key") == F.col("__key")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    rows = rows.select("way", "s", "n", "entry", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    block, asker = F.when(F.col("entry"), F.col("own")).otherwise(F.col("other")), F.when(F.col("entry"), F.col("other")).otherwise(F.col("own"))
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * total // SHARD)
    cell = F.pmod(F.xxhash64("key", block, asker), F.lit(shards)) * 2 + F.col("way")
    rows = rows.select(cell.alias("cell"), "s", "n", "entry")

    def search(table: pa.Table) -> pa.Table:
        way = table.column("cell")[0].as_py() & 1
        known, words = {}, []
        for s, n, entry in zip(table.column("s").to_pylist(), table.column("n").to_pylist(), table.column("entry").to_pylist(), strict=True):
            if entry:
                known[s] = n
            else:
                words.append((s, n))
        listed = sorted(known)
        automaton = Automaton(listed)
        out: tuple[list, ...] = ([], [], [], [])
        turn = (lambda s: s[::-1]) if way else (lambda s: s)
        for s, n in set(words):  # a word searches a shard once, whatever cells of it are its own
            half = len(s) // 2
            for number in automaton.near(s, len(s) - half if way else half):
                near = listed[number]
                for column, value in zip(out, (turn(s), n, turn(near), known[near]), strict=True):
                    column.append(value)
        return pa.table({"word": pa.array(out[0], pa.string()), "n": pa.array(out[1], pa.int64()), "near": pa.array(out[2], pa.string()), "near_n": pa.array(out[3], pa.int64())})

    pairs = rows.groupBy("cell").applyInArrow(search, "word string, n long, near string, near_n long")
    return pairs.repartition("word").distinct()


def spelling_forms(vocabulary: DataFrame) -> DataFrame:
    """(word, n, form, root, n_near long, form_n): a row for each word of vocabulary(word, n).

    form is the near word with the most occurrences (the first in code-point order of several) if it has at least LEAD times the word's, else
    null, and form_n its occurrences; root is where the forms end, the word itself if it has none; n_near counts its near words.
    """
    vocabulary = stage_table(vocabulary.select("word", "n"), "vocabulary")
    # Spark orders strings by their UTF-8 bytes, which is the order of code points.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = near_words(vocabulary).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = near.select(F.col("word").alias("__word"), "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    rows = vocabulary.join(near, F.col("word") == F.col("__word"), "left")
    leads = F.col("near_n") >= LEAD * F.col("n")
    rows = rows.select("word", "n", F.when(leads, F.col("near")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(leads, F.col("near_n")).alias("form_n"))
    rows = stage_table(rows, "forms")

    # Counts at least double from form to form, so a chain has at most 63 of them, and each round of pointers halves what is left of it.
    pointers, moved = stage_table(rows.where("form is not null").select("word", F.col("form").alias("root")), "pointers"), True
    while moved:
        ahead = pointers.select(F.col("word").alias("__at"), F.col("root").alias("__next"))
        step = pointers.join(ahead, F.col("root") == F.col("__at"), "left")
        step = stage_table(step.select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "pointers")
        pointers, moved = step.select("word", "root"), not step.where("moved").isEmpty()
    pointers = pointers.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
    return rows.join(pointers, F.col("word") == F.col("__word"), "left").select("word", "n", "form", F.coalesce("__root", "word").alias("root"), "n_near", "form_n")

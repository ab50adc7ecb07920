"""Problem 8: encode a whole corpus with a byte-level BPE tokenizer, inside Spark's own expressions.

The corpus is cut into words by the tokenizer's pattern. The bytes of a word become token ids and a
higher-order fold merges the adjacent pair of lowest rank until none is left. The ranks are a literal hash
table, so a lookup takes constant time (a literal map is searched linearly). The most frequent distinct words of the
corpus, a bounded number, are folded once and travel to the documents as a second literal table; the others, most of
which occur once, are folded where they stand, so that no document is shuffled.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import stage

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The words of byte_bpe_50k (fixed value of the tokenizer); (?U) gives \s its Unicode meaning in Java.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words sent to all tasks with their ids; the bound of that literal table.
FREQUENT_WORDS = 32768
_NONE = 1 << 20  # above every rank
_DIRECT = 0x530  # characters with a first state of their own: Latin, Greek, Cyrillic
_BUCKETS = 65537  # of the rank table


@lru_cache(4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """(left id << 16 | right id) -> id of the merged token, for every way to cut a token in two tokens."""
    out = {}
    for token, i in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k]), ranks.get(token[k:])
            if a is not None and b is not None:
                out[a << 16 | b] = i
    return out


@lru_cache(4)
def _rank_table(path: str) -> list[dict[str, int] | None]:
    """Hash table of the mergeable pairs: in bucket (31 a + b) mod BUCKETS, the id of the token by b.

    b alone tells the pairs of a bucket apart, as equal b and bucket mean equal a (BUCKETS is a prime above every id).
    """
    out: list[dict[str, int] | None] = [None] * _BUCKETS
    for pair, i in pair_ranks(read_ranks(path)).items():
        a, b = pair >> 16, pair & 65535
        at = (31 * a + b) % _BUCKETS
        out[at] = (out[at] or {}) | {str(b): i}
    return out


def _literal(values: list, kind: str) -> Column:
    """A literal array; the optimizer folds the parse into a constant."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _merged(table: Column, a: Column, b: Column) -> Column:
    """Id of the token that ``a`` and ``b`` merge into; null if they don't. A pair's rank is that id."""
    return F.try_element_at(F.get(table, (a * 31 + b) % _BUCKETS), b)


@lru_cache(4)
def first_state(path: str) -> tuple[list[list[int]], list[list[int]]]:
    """Token ids that the characters below _DIRECT start with: inside a word, and at its start after a space.

    A character of several bytes starts as one token, if its own merges have lower ranks than any merge across
    its edges, whatever stands there, so that they would come first anyway. Otherwise it starts as its bytes.
    """
    ranks = read_ranks(path)
    never = _NONE
    by_first: dict[int, int] = {}  # least rank of a token that starts with the byte and has more
    by_last: dict[int, int] = {}  # the same for tokens that end with it, after anything but a space
    for token, r in ranks.items():
        if len(token) > 1:
            by_first[token[0]] = min(by_first.get(token[0], never), r)
            if token[-2] != 0x20:
                by_last[token[-1]] = min(by_last.get(token[-1], never), r)

    def settle(octets: bytes, spaced: bool) -> list[int]:
        parts = [octets[i : i + 1] for i in range(len(octets))]
        while len(parts) > 1:
            r, k = min((ranks.get(parts[i] + parts[i + 1], never), i) for i in range(len(parts) - 1))
            # whatever follows may only merge later, and so may whatever precedes
            across = min(never if spaced else by_last.get(parts[0][0], never), by_first.get(parts[-1][0], never))
            if r == never or r >= across:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[x] for x in parts]

    inside = [settle(chr(c).encode(), False) for c in range(_DIRECT)]
    spaced = [settle(b" " + chr(c).encode(), True) for c in range(_DIRECT)]
    return inside, spaced


def _tables(path: str) -> Column:
    """All literal tables as one struct."""
    ranks = read_ranks(path)
    inside, spaced = first_state(path)
    single = [ranks[bytes([i])] for i in range(256)]
    return F.struct(
        _literal(_rank_table(path), "array<map<string,int>>").cast("array<map<int,int>>").alias("t"), _literal(single, "array<int>").alias("s"),
        _literal(inside, "array<array<int>>").alias("c"), _literal(spaced, "array<array<int>>").alias("d"),
    )


def _done(state: Column) -> Column:
    return F.array_min(state) >= _NONE * 65536


def _times(n: int) -> Column:
    return F.lit([0] * n)


def encode_word(word: Column, tables: Column) -> Column:
    """Token ids of one word (array of int): a fold that merges the adjacent pair of lowest rank, while there is one."""
    t, singles = tables["t"], tables["s"]

    def octets(text: Column) -> Column:
        hexed = F.hex(F.encode(text, "UTF-8"))
        return F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda i: F.get(singles, F.conv(F.substring(hexed, 2 * i - 1, 2), 16, 10).cast("int")))

    def start(chars: Column) -> Column:
        # every character by its code point; other characters by their bytes
        one = lambda c: F.coalesce(F.get(tables["c"], F.ascii(c)), octets(c))
        led = F.get(tables["d"], F.ascii(F.get(chars, F.lit(1))))
        plain = F.flatten(F.transform(chars, one))
        after_space = F.concat(led, F.flatten(F.transform(F.slice(chars, 3, F.size(chars)), one)))
        return F.when((F.size(chars) > 1) & (F.get(chars, F.lit(0)) == " ") & led.isNotNull(), after_space).otherwise(plain)

    # an element is (rank of the pair that begins here) * 65536 + id, so that one array holds both and its least element is the next merge
    def entry(a: Column, b: Column) -> Column:
        return F.coalesce(_merged(t, a, b), F.lit(_NONE)).cast("bigint") * 65536 + a

    def step(acc: Column, _: Column) -> Column:
        def merge_lowest(m: Column) -> Column:
            def merge(p: Column) -> Column:
                new, ahead = F.shiftright(m, 16).cast("int"), (F.get(acc, p + 1) % 65536).cast("int")
                tail = [F.array(entry(new, ahead)), F.slice(acc, p + 2, F.size(acc))]
                head = [F.slice(acc, 1, p - 2), F.array(entry((F.get(acc, p - 2) % 65536).cast("int"), new))]
                return F.when(p > 1, F.concat(*head, *tail)).otherwise(F.concat(*tail))

            return _with(F.array_position(acc, m).cast("int"), merge)

        return F.when(_done(acc), acc).otherwise(_with(F.array_min(acc), merge_lowest))

    def run(ids: Column) -> Column:
        # the last element begins no pair
        ranked = F.transform(ids, lambda a, i: entry(a, F.get(ids, i + 1)))
        plain = lambda v: F.transform(v, lambda x: (x % 65536).cast("int"))

        def fold(begin: Column) -> Column:
            # most words take a few merges: a short fold, a longer one, and one that surely is long enough
            rest = lambda acc: F.aggregate(ids, acc, step, plain)
            longer = lambda acc: F.when(_done(acc), plain(acc)).otherwise(F.aggregate(_times(6), acc, step, lambda x: F.when(_done(x), plain(x)).otherwise(rest(x))))
            return F.when(_done(begin), ids).otherwise(F.aggregate(_times(3), begin, step, longer))

        return F.when(F.size(ids) > 1, _with(ranked, fold)).otherwise(ids)

    return _with(_with(F.split(word, ""), start), run)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def frequent_words(df: DataFrame, text: str, path: str = BYTE_BPE, limit: int = FREQUENT_WORDS) -> list[tuple[str, list[int]]]:
    """The most frequent words of the whole corpus with their ids: at most ``limit`` rows, most frequent first.

    A histogram of the counts, on a scale of sixteenths of a power of two, gives the least count that keeps within the limit; only
    words of that count reach the driver.
    """
    counted = stage(df.select(F.explode(words(F.col(f"`{text}`"))).alias("word")).where(F.length("word") <= 64).groupBy("word").agg(F.count("*").alias("n")), "words")
    level = F.floor(F.log2("n") * 16).cast("int")
    least, left = None, limit
    for r in sorted(counted.groupBy(level.alias("at")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["at"]):  # at most 16 * 63 rows
        if r["n"] > left:
            break
        least, left = r["at"], left - r["n"]
    if least is None:
        return []
    tables = _tables(path)
    found = counted.where(level >= least).select("word", "n", _with(tables, lambda x: encode_word(F.col("word"), x)).alias("ids")).collect()
    return [(r.word, r.ids) for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


def _by_hash(known: list[tuple[str, list[int]]], spark: SparkSession) -> tuple[Column, int]:
    """Literal table of words by hash; where two share a slot, the more frequent one has it, the other is folded."""
    slots = 4 * len(known) + 1
    if not known:
        return _literal([None], "array<struct<w:string,i:array<int>>>"), slots
    frame = spark.createDataFrame(known, "w string, i array<int>").select("w", F.pmod(F.xxhash64("w"), F.lit(slots)).alias("h"))
    place = {r.w: r.h for r in frame.collect()}
    table: list = [None] * slots
    for w, ids in reversed(known):
        table[place[w]] = {"w": w, "i": ids}
    return _literal(table, "array<struct<w:string,i:array<int>>>"), slots


def encode(df: DataFrame, key: str, text: str, path: str = BYTE_BPE, out: str = "ids", frequent: int = FREQUENT_WORDS) -> DataFrame:
    """``key`` and the token ids of ``text`` (array of int, in ``out``), without special tokens.

    Empty and null texts give an empty list. Repeated rows are kept as they are, null keys included. Other
    columns are dropped, so their names can't clash. An empty table gives an empty table.
    """
    base = df.select(F.col(f"`{key}`").alias("_k"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_t"))
    known, size = _by_hash(frequent_words(base, "_t", path, frequent), df.sparkSession)
    tables = _tables(path)

    def ids(all_tables: Column) -> Column:
        k, x = all_tables["k"], all_tables["x"]

        def look(w: Column) -> Column:
            e = F.get(k, F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
            return F.when(e["w"] == w, e["i"])

        return F.flatten(F.transform(words(F.col("_t")), lambda w: F.coalesce(look(w), encode_word(w, x))))

    every = F.struct(known.alias("k"), tables.alias("x"))
    return base.select(F.col("_k").alias(key), _with(every, ids).alias(out))


def decode(ids: Column, path: str = BYTE_BPE) -> Column:
    """Text of token ids: the binary pieces one after the other. Null for null."""
    ranks = read_ranks(path)
    pieces = [""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        pieces[i] = token.hex()
    return _with(_literal(pieces, "array<string>"), lambda p: F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(p, i)), "")), "UTF-8"))

"""Benchmark decontamination in DataFrame functions only.

Benchmark texts become windows of n normalised words, broadcast as a hash
table.  A window of k words holds a whole aligned block of (k + 1) // 2 words
wherever it starts, so of a document only aligned blocks are looked up first,
in a bitmap of bounded size that goes into the plan; about a block that is
found, the windows themselves are looked up in the bitmap, and only those found
leave the row to be verified word by word in the join with the windows.

Windows that belong to the same items share the number of that set of items,
so a hit carries one short value however many items have the window; item ids
are met once for each combination of sets.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm._spark import broadcast_if_small, materialize

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What is between words of a text that isn't lower-cased, and one word with what is before it.
_GAP, _PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the bitmap at most (512 KB); beyond that more windows pass it and the join does the rest.
MAX_BITS = 1 << 22
_BLOCK, _WINDOW = 0, 1


class Found(NamedTuple):
    """``docs``: row, id, n_words, hits array<struct<pos, len>>, combo (null without hits); ``items``: combo, items, one row per combination that occurs."""

    docs: DataFrame
    items: DataFrame


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does that where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)``, with value computed once per row however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _mark(kind: int, k: int, hashes: Column, start: Column, length: int) -> Column:
    """Hash of ``length`` word hashes from ``start`` (from 0) on, as a block or window of windows of k words."""
    return F.xxhash64(F.lit(kind), F.lit(k), F.slice(hashes, start + 1, length))


def benchmark_windows(benchmark: DataFrame, n: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, len int, key string, w array): windows of each item; an item of fewer words, but not none, is one window."""
    w, size = F.col("w"), F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
    rows = benchmark.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter(size > 0)
    rows = rows.withColumn("len", F.least(size, F.lit(n))).withColumn("at", F.explode(starts))
    rows = rows.select("item", "len", F.slice(w, F.col("at"), F.col("len")).alias("w"))
    return rows.withColumn("key", F.array_join("w", " "))


def _bitmap(windows: DataFrame, lengths: list[int]) -> tuple[Column, int]:
    """(array<bigint> literal, number of bits): a bit for each window and for each block that a window may hold."""
    marks = F.array().cast("array<bigint>")
    h = _hashes(F.split("key", " "))
    for k in lengths:
        b = (k + 1) // 2
        own = F.array(_mark(_WINDOW, k, F.col("h"), F.lit(0), k), *[_mark(_BLOCK, k, F.col("h"), F.lit(i), b) for i in range(b)])
        marks = F.when(F.col("len") == k, own).otherwise(marks)
    rows = windows.select("len", h.alias("h")).select(F.explode(marks).alias("h")).distinct()
    rows = materialize(rows, "marks")
    bits = min(MAX_BITS, max(1 << 12, 1 << (64 * rows.count()).bit_length()))
    slot = F.pmod("h", F.lit(bits))
    rows = rows.select(F.floor(slot / 64).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int")).alias("b")).groupBy("i").agg(F.bit_or("b").alias("b")).collect()  # bits / 64 at most
    values = ["0"] * (bits // 64)
    for r in rows:
        values[r["i"]] = str(r["b"])
    return F.split(F.lit(",".join(values)), ",").cast("array<bigint>"), bits


def _maybe(row: Column, k: int, bits: int) -> Column:
    """Windows of k words that the bitmap has, of a row with w, h (word hashes) and bitmap: array<struct<pos, len, key>>."""
    w, h, bitmap = row["w"], row["h"], row["bitmap"]
    n, b = F.size(h), (k + 1) // 2

    def known(kind: int, start: Column, length: int) -> Column:
        slot = F.pmod(_mark(kind, k, h, start, length), F.lit(bits))
        return F.getbit(bitmap[F.shiftright(slot, 6).cast("int")], slot.bitwiseAND(F.lit(63)).cast("int")) == 1

    none = F.array().cast("array<int>")
    blocks = F.filter(F.when(n >= k, F.sequence(F.lit(0), n - b, F.lit(b))).otherwise(none), lambda s: known(_BLOCK, s, b))

    def starts(s: Column) -> Column:
        low, high = F.greatest(s - (b - 1), F.lit(0)), F.least(s, n - k)
        return F.when(low <= high, F.sequence(low, high)).otherwise(none)

    hit = F.filter(F.flatten(F.transform(blocks, starts)), lambda i: known(_WINDOW, i, k))
    return F.transform(hit, lambda i: F.struct(i.alias("pos"), F.lit(k).alias("len"), F.array_join(F.slice(w, i + 1, k), " ").alias("key")))


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> Found:
    """The windows of benchmark items that occur in each document.

    ``pos`` is the number of the first word of an occurrence, from 0; ``items``
    are the distinct ids of the items with such windows, as sorted strings (a
    null id has windows, and no place among them).  Null or empty texts have no
    words; an empty benchmark hits nothing.  One row per input row, also where
    rows or ids repeat; other columns are not read.  A row takes memory for
    some ten times its text.
    """
    own = benchmark_windows(benchmark, n, item_col, item_text_col).select("len", "key", F.col("item").cast("string").alias("item")).distinct()
    own = materialize(own, "item-windows")
    numbered = own.groupBy("key", "len").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("y"))
    windows = materialize(numbered.select("key", "len", F.md5(F.concat_ws(":", "n", "x", "y")).alias("set")), "windows")
    lengths = sorted(r[0] for r in windows.select("len").distinct().collect())  # n of them at most
    bitmap, bits = _bitmap(windows, lengths)

    def found(row: Column) -> Column:
        none = F.array().cast("array<struct<pos:int,len:int,key:string>>")
        return F.struct(F.size(row["w"]).cast("long").alias("n_words"), F.concat(none, *[_maybe(row, k, bits) for k in lengths]).alias("maybe"))

    def hashed(w: Column) -> Column:
        return bound(F.struct(w.alias("w"), _hashes(w).alias("h"), bitmap.alias("bitmap")), found)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    seen = rows.select("row", "id", bound(words(F.col("t")), hashed).alias("f"))
    seen = seen.select("row", "id", "f.n_words", F.explode_outer("f.maybe").alias("m")).select("row", "id", "n_words", "m.pos", "m.len", "m.key")
    known = broadcast_if_small(windows.select(F.col("key").alias("k"), F.col("len").alias("l"), "set"))
    hit = seen.join(known, (F.col("key") == F.col("k")) & (F.col("len") == F.col("l")), "left")
    hit = hit.groupBy("row", "id", "n_words").agg(
        F.array_sort(F.collect_set(F.when(F.col("set").isNotNull(), F.struct("pos", "len")))).alias("hits"),
        F.array_sort(F.collect_set("set")).alias("sets"),
    )
    hit = materialize(hit.withColumn("combo", F.when(F.size("sets") > 0, F.md5(F.array_join("sets", ",")))), "hits")
    combos = hit.filter("combo is not null").groupBy("combo").agg(F.first("sets").alias("sets")).select("combo", F.explode("sets").alias("set"))
    members = windows.join(own, ["key", "len"]).select("set", "item").distinct()
    items = combos.join(members, "set", "left").groupBy("combo").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return Found(hit.drop("sets"), items)


def covered(hits: Column) -> Column:
    """Words in the union of the (pos, len) spans, which are in order."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, h: Column) -> Column:
        end = F.greatest(acc["end"], h["pos"] + h["len"])
        return F.struct(end.alias("end"), (acc["n"] + end - F.greatest(acc["end"], h["pos"])).alias("n"))

    return F.aggregate(hits, start, step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, mode: str = "documents", id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without documents (mode ``documents``) or word spans (mode ``spans``) that occur in the benchmark.

    Spans go with the characters before each of their words.  The columns of
    ``docs`` are kept as they are.  What is judged is the text, so rows find
    their hits by its MD5 and not by a row number, which a second evaluation
    of ``docs`` could give to another row; a null text stays.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode is documents or spans, not {mode!r}")
    sign = F.md5(F.col(text_col).cast("string"))
    hit = scan(docs.select(sign.alias("id"), F.col(text_col).alias("t")), benchmark, n, "id", "t", item_col, item_text_col).docs.filter("combo is not null")
    hit = materialize(hit.groupBy("id").agg(F.first("hits").alias("hits")), "hit-texts")
    rows = docs.select(F.struct("*").alias("doc"), sign.alias("sign"))
    if mode == "documents":
        gone = broadcast_if_small(hit.select("id"))
        return rows.join(gone, F.col("sign") == F.col("id"), "left_anti").select("doc.*")

    def cut(text: Column, hits: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit("(?s)" + _PIECE), F.lit(0))
        gone = F.flatten(F.transform(hits, lambda h: F.sequence(h["pos"], h["pos"] + h["len"] - 1)))
        kept = bound(pieces, lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), gone), lambda i: p[i]), ""))
        return F.concat(kept, F.regexp_extract(text, "(?s)" + _GAP + r"\z", 0))

    out = rows.join(broadcast_if_small(hit), F.col("sign") == F.col("id"), "left")
    text = F.col(f"doc.{text_col}")
    return out.select(*[(F.when(F.col("hits").isNull(), text).otherwise(cut(text, F.col("hits"))) if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])

"""Order-MinHash fingerprints, with DataFrame functions only.

A text is the sequence of its words (runs without ASCII white space, cut
after ``WORD_CHARS`` characters, so that unspaced text has words too), and a
k-mer is ``K`` words in a row together with its occurrence number, so that
repeats count.  One hash places every numbered k-mer in one of ``BINS`` bins
(one permutation cut into bins stands for one permutation per bin); in each
bin the two k-mers of smallest hash are selected, put back into text order
and hashed as a pair.  The pairs of two texts agree where the same k-mers
come in the same order, so moving passages about lowers the likeness, unlike
with plain MinHash.

Numbered k-mers travel as single longs, hash bits above and ``POS_BITS`` bits
of position below, so both sorts are sorts of plain longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsight.llm.common import shuffle_partitions

K = 3
BINS = 64  # a power of two
WORD_CHARS = 16
POS_BITS = 24
POS = (1 << POS_BITS) - 1


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _upper(v: Column) -> Column:
    return F.shiftright(v, POS_BITS)


def _bin(v: Column) -> Column:
    return F.shiftrightunsigned(v, 64 - (BINS.bit_length() - 1))


def _packed(h: Column, pos: Column) -> Column:
    return F.shiftleft(_upper(h), POS_BITS).bitwiseOR(pos.cast("long").bitwiseAND(F.lit(POS)))


def kmers(text: Column) -> Column:
    """Sorted (hash of k-mer, position) longs of a text."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % WORD_CHARS), F.lit(0))

    def from_hashes(w):
        each = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - K, F.lit(0))), lambda i: _packed(
            F.xxhash64(*[F.get(w, i + j) for j in range(K)]), i))
        return F.when(F.size(w) > 0, each).otherwise(F.array().cast("array<bigint>"))
    return F.sort_array(_bind(F.transform(words, lambda x: F.xxhash64(x)), from_hashes))


def numbered(sorted_kmers: Column) -> Column:
    """Sorted (hash of k-mer and occurrence number, position) longs: equal
    k-mers are neighbours in text order, so the place in the run is the
    occurrence number."""
    def runs(s):
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i < n) & (
            (i == 0) | (_upper(F.get(s, i)) != _upper(F.get(s, i - 1)))))
        return _bind(starts, lambda st: F.flatten(F.transform(st, lambda a, j: F.transform(
            F.slice(s, a + 1, F.coalesce(F.get(st, j + 1), n) - a),
            lambda v, o: _packed(F.xxhash64(_upper(v), o), v.bitwiseAND(F.lit(POS)))))))
    return F.sort_array(_bind(sorted_kmers, runs))


def signature(sorted_numbered: Column) -> Column:
    """One long per non-empty bin: bin number above, 32 bits of the hash of its
    pair of smallest k-mers in text order below."""
    def pairs(s):
        first_two = F.filter(s, lambda v, i: (i < 2) | (_bin(v) != _bin(F.get(s, F.greatest(i - 2, F.lit(0))))))

        def entry(t, v, i):
            new = (i == 0) | (_bin(v) != _bin(F.get(t, F.greatest(i - 1, F.lit(0)))))
            two = F.get(t, i + 1)
            paired = two.isNotNull() & (_bin(two) == _bin(v))
            ahead = v.bitwiseAND(F.lit(POS)) < two.bitwiseAND(F.lit(POS))
            h = (F.when(~F.coalesce(paired, F.lit(False)), F.xxhash64(_upper(v)))
                 .when(ahead, F.xxhash64(_upper(v), _upper(two))).otherwise(F.xxhash64(_upper(two), _upper(v))))
            return F.when(new, F.shiftleft(_bin(v), 32).bitwiseOR(F.shiftrightunsigned(h, 32)))
        return _bind(first_two, lambda t: F.filter(F.transform(t, lambda v, i: entry(t, v, i)), lambda x: x.isNotNull()))
    return _bind(sorted_numbered, pairs)


def as_text(sig: Column) -> Column:
    """The signature as a string: ten hexadecimal digits per non-empty bin."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal pairs among the bins that are non-empty in either; two
    texts without words are alike."""
    def bins(s):
        return F.transform(s, lambda x: F.shiftright(x, 32))
    either = F.size(a) + F.size(b) - F.size(F.array_intersect(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _key(id_col: str, text_col: str) -> Column:
    """Place in ascending order of the id: null ids last, then a hash of the text."""
    return F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"))


def with_next(df: DataFrame, id_col: str, text_col: str, partitions: int, sampled: int = 6) -> DataFrame:
    """(doc_id, text, sig, next_text, next_sig): each row with the row that
    follows in ascending order of the id (of any type that can be sorted; null
    ids last, then by a hash of the text; after the last the first; a single
    row follows itself).

    Rows are dealt to ranges between keys of a hash sample (``sampled`` for
    each of 4 * partitions ranges; one row of two levels, so a row finds its
    range in about twice the root of their number of comparisons).  The row at
    a border is also put at the end of the range before it, so the text is
    shuffled once and no range is held by one task alone; null and repeated
    ids are spread by their text's hash."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("key", _key("doc_id", "text"))
    n_ranges = 4 * partitions
    n, first = keyed.agg(F.count(F.lit(1)), F.min("key")).first()
    drawn = F.pmod(F.xxhash64("key", F.lit(1)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sampled * n_ranges / max(1, n)))
    sample = [r["key"] for r in keyed.where(drawn).select("key").distinct().orderBy("key").collect()]
    cuts = [c for c in dict.fromkeys(sample[len(sample) * k // n_ranges] for k in range(1, n_ranges) if sample) if c != first]
    width = max(1, int(len(cuts) ** 0.5))
    kind = keyed.schema["key"].dataType.simpleString()
    table = spark.createDataFrame(
        [(cuts[::width], [cuts[k:k + width] for k in range(0, len(cuts), width)], first)],
        f"heads array<{kind}>, blocks array<array<{kind}>>, first {kind}")
    block = F.size(F.filter("heads", lambda c: c <= F.col("key"))) - 1
    inside = F.get("blocks", F.col("block"))
    at_cut = F.col("block").between(0, len(cuts)) & F.array_contains(inside, F.col("key"))
    places = F.array_compact(F.array(
        F.struct(F.col("own").alias("range"), F.lit(0).alias("tail")),
        F.when(at_cut, F.struct((F.col("own") - 1).alias("range"), F.lit(1).alias("tail"))),
        F.when(F.col("key") == F.col("first"), F.struct(F.lit(len(cuts)).alias("range"), F.lit(1).alias("tail")))))
    dealt = (keyed.crossJoin(F.broadcast(table))  # one row
             .withColumn("block", block)
             .withColumn("own", F.when(F.col("block") < 0, F.lit(0)).otherwise(
                 F.col("block") * width + F.size(F.filter(inside, lambda c: c <= F.col("key")))))
             .select("doc_id", "text", "key", F.inline(places))
             .repartition(partitions, "range")
             .withColumn("kmers", kmers(F.col("text"))).withColumn("kmers", numbered(F.col("kmers")))
             .withColumn("sig", signature(F.col("kmers"))).drop("kmers"))
    order = Window.partitionBy("range").orderBy("tail", "key")
    return dealt.select(
        "doc_id", "text", "sig", "tail", F.lead("text").over(order).alias("next_text"),
        F.lead("sig").over(order).alias("next_sig")).where("tail = 0").select(
        "doc_id", "text", "sig", F.coalesce("next_text", "text").alias("next_text"),
        F.coalesce("next_sig", "sig").alias("next_sig"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 partitions: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every row.

    The edited text is the text with its last floor(n_chars / 2) characters
    replaced by the first as many (or all) of the next document.  Null text
    counts as empty: its fingerprint is the empty string.  Ids are meant to be
    unique; repeated ids are ordered by a hash of their text."""
    parts = partitions or shuffle_partitions(df.sparkSession)
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half),
                      F.substring(F.col("next_text"), F.lit(1), half))
    return (with_next(df, id_col, text_col, parts)
            .withColumn("n_chars", F.char_length("text")).withColumn("edited", edited).drop("text", "next_text")
            .withColumn("kmers", kmers(F.col("edited"))).withColumn("kmers", numbered(F.col("kmers")))
            .withColumn("edited_sig", signature(F.col("kmers"))).drop("kmers")
            .select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                    as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
                    likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                    likeness(F.col("sig"), F.col("next_sig")).alias("near_next")))

"""Quality rules with cross-document line frequency, in SQL functions only.

*Measures* of a text come from its words (runs of ``[^\\x20\\x09-\\x0D]``) and
lines.  A word is *repeated* when it lies in an 8-word window found twice or
more in the text; windows are compared by 64-bit hashes, a text without a
repeated window is settled by one set operation, and otherwise the repeated
windows' places are counted through sorted (hash, place) pairs, so a long text
costs n log n.

*Line frequency.*  A line is normalised (lower case, white space runs to
one space, trimmed, digit runs to one ``0``) and hashed with its host.  Each
line counts once per distinct text of a host, so copies of one text do not make
its lines boilerplate.  A line above the host's limit -- more than
``max(least, share * distinct texts of the host)`` texts -- is removed
(``kept_documents`` gives the texts without such lines), and a text is *depleted* when fewer than ``min_words`` words, or less than
``left_share`` of them, remain.

Verdicts belong to (host, text), so no row identity is needed: the measured
table is keyed by the text's digest, lines of distinct texts are counted with
map-side partial sums, and a hot host is spread over its lines' hashes.

Edge cases: null text has no words (and fails the base rule); a null host is a
host of its own; repeated rows get the same verdict each; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quire.session import materialize

WORD_GAP = "[\x20\x09-\x0D]+"
A_WORD = "[^\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row, also where lambdas
    inside the body use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_GAP), "")


def window_hashes(words_: Column, width: int) -> Column:
    """One hash per window of ``width`` words; none if there are fewer.  Each
    word is fetched by place: ``slice`` would copy the whole array per window."""
    def over(w: Column) -> Column:
        n = F.size(w) - width
        return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(
            *[F.get(w, i + j) for j in range(width)]))).otherwise(F.array().cast("array<bigint>"))

    return let(words_, over)


def covered_by_repeats(windows: Column, width: int) -> Column:
    """Words that lie in a window whose hash occurs twice or more."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        last = F.size(s)
        same = lambda i, j: F.get(s, j)["h"] == F.get(s, i)["h"]
        kept = F.filter(s, lambda x, i: ((i > 0) & same(i, i - 1)) | ((i < last - 1) & same(i, i + 1)))
        return F.array_sort(F.transform(kept, lambda x: x["i"]))

    def spans(p: Column) -> Column:
        return F.aggregate(
            F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(width), F.get(p, i + 1) - x), F.lit(width))),
            F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(placed, places), spans)


def line_entry(line: Column, host: Column) -> Column:
    """A line's hash with its host, in the form that is counted, and its words."""
    return let(F.trim(F.regexp_replace(line, WORD_GAP, " ")), lambda x: F.struct(
        F.xxhash64(host.isNull(), host, F.regexp_replace(F.lower(x), "[0-9]+", "0")).alias("line"),
        F.size(F.split(x, " ")).alias("n")))


def measures(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """Per row: key, host, digest, the base measures, and its lines' hashes
    (``lines``: line hash with the line's words, distinct lines summed later)."""
    d = docs.select(F.col(key).alias("key"), F.col(host).alias("host"),
                    F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("words", words(F.col("text")))
    d = d.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: x.rlike(A_WORD)))
    d = d.withColumn("windows", window_hashes(F.col("words"), WINDOW))
    return d.select(
        "key", "host", F.unhex(F.md5("text")).alias("digest"),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long"))
         .otherwise(covered_by_repeats(F.col("windows"), WINDOW)).alias("n_repeat_words"),
        F.transform("lines", lambda x: line_entry(x, F.col("host"))).alias("lines"))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                  min_words: int = 20, repeat_percent: int = 30, share: float = 0.01,
                  least: int = 20, left_share: float = 0.3) -> DataFrame:
    """Per row: ``key``, ``host``, digest (MD5 of the text), the measures,
    base_failed, n_line_words (words in removed lines), kept, and removed (the
    removed lines' places among the text's lines with words; null if none), which
    ``without_lines`` takes."""
    measured = materialize(measures(docs, key, text, host), "measured")
    texts = measured.select("host", "digest", "lines").groupBy("host", "digest").agg(
        F.first("lines").alias("lines"))
    texts = materialize(texts, "texts")
    hosts = texts.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("texts"))
    lines = texts.select("host", "digest", F.posexplode("lines").alias("at", "l")).select(
        "host", "digest", "at", "l.line", "l.n")
    above = (texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda l: l["line"]))).alias("line"))
             .groupBy("host", "line").agg(F.count("*").alias("held")).where(F.col("held") > least)
             .join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("held") > share * F.col("texts"))
             .select("line"))
    gone_lines = lines.join(above, "line").groupBy("host", "digest").agg(
        F.sum("n").alias("gone"), F.collect_list("at").alias("removed"))
    r = gone_lines.select(F.col("host").alias("r_host"), F.col("digest").alias("r_digest"), "gone", "removed")
    out = measured.drop("lines").join(
        r, F.col("host").eqNullSafe(F.col("r_host")) & (F.col("digest") == F.col("r_digest")), "left")
    gone = F.coalesce("gone", F.lit(0)).cast("long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    depleted = (F.col("n_line_words") > 0) & ((left < min_words) | (left < left_share * F.col("n_words")))
    return (out.withColumn("n_line_words", gone).withColumn("base_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & ~depleted)
            .select(F.col("key").alias(key), F.col("host").alias(host), "digest", "n_words", "word_chars",
                    "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_line_words", "kept", "removed"))


def without_lines(text: Column, removed: Column) -> Column:
    """``text`` without the lines at these places among its lines with words."""
    def rest(lines: Column) -> Column:
        every = F.sequence(F.lit(0), F.size(lines) - 1)
        worded = F.filter(every, lambda i: F.get(lines, i).rlike(A_WORD))
        left = let(worded, lambda w: F.array_except(every, F.transform(removed, lambda i: F.get(w, i))))
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")

    return F.when(removed.isNull(), text).otherwise(let(F.split(text, "\n", -1), rest))


def kept_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source",
                   length: str = "n_chars") -> DataFrame:
    """The rows that the rules keep, with the lines above the limit taken out of
    ``text`` and ``length`` counted anew where a line went; all other columns stay."""
    verdicts = quality_rules(docs, key, text, host).where(~F.col("kept") | F.col("removed").isNotNull())
    # one row for each (host, text): all rows of a text have the same verdict;
    # its columns have names that no column of docs has
    own = "v"
    while any(c.lower().startswith(own + "_") for c in docs.columns):
        own += "v"
    of, mark, stays, lost = (f"{own}_{c}" for c in ("host", "digest", "kept", "removed"))
    v = verdicts.select(F.col(host).alias(of), F.col("digest").alias(mark), F.col("kept").alias(stays),
                        F.array_sort("removed").alias(lost)).dropDuplicates([of, mark])
    digest = F.unhex(F.md5(F.coalesce(docs[text], F.lit(""))))
    found = docs.join(v, docs[host].eqNullSafe(v[of]) & (digest == v[mark]), "left").where(F.coalesce(stays, F.lit(True)))
    changed = F.col(lost).isNotNull()
    found = found.withColumn(text, without_lines(F.col(text), F.col(lost)))
    return found.withColumn(length, F.when(changed, F.length(text).cast(docs.schema[length].dataType))
                            .otherwise(F.col(length))).select(docs.columns)

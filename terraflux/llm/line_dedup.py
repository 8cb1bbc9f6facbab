"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of the last ``window`` lines ends a chunk where it
is 0 modulo ``divisor``, so the same run of lines is cut at the same places
wherever it stands, but for its first and last lines. A line of more than
``long_words`` words is a chunk of its own, since it is a passage already. A chunk
of two or more lines, or of one such long line, that occurs before is removed: in
the order of (doc_id, text hash, place) the first occurrence stays.

So that a repeated passage goes as a whole, wherever chunks are cut, there are more
candidates: from each line the shortest run of more than ``long_words`` words that
starts there, and the shortest that ends there. Any longer run that occurs earlier
is covered by these, line by line. So is a whole document, whatever its length.

Candidates travel as hashes only. A first pass counts them and finds the first
occurrence of each, combined before the shuffle; a second finds the later ones.
Candidates of a document that lie at the same shift from the same earlier document
are merged into the longest repeated runs, and only the text of these is fetched
and compared byte for byte. Joins stand on a recurring hash or on a first
occurrence, which may be very frequent: both sides of each are read from tables, and
at every size they are sort-merge joins, whose heavy partitions adaptive execution
splits.
Rows with equal id and text count as one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CLASS, free_name, materialise, table

WINDOW, DIVISOR, LONG_WORDS = 2, 3, 50
_MODULUS = 1_000_003


def _line_hash(line: Column) -> Column:
    """A number below 2^32 from the line's bytes."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _run_hash(line_hashes: Column) -> Column:
    return F.xxhash64(line_hashes)


def _n_words(x: Column) -> Column:
    return F.size(F.filter(F.split(x, f"{SPACE_CLASS}+"), lambda w: w != ""))


def _span(first: Column, last: Column) -> Column:
    return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"))


def _with_words_before(df: DataFrame, block: int = 256) -> DataFrame:
    """df (words: of each line) with ``before``: for each line, and the end, the number of words before
    it. Sums are made by blocks, since an array that grows by a line is copied for each."""
    zero = F.array(F.lit(0))
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    starts = F.sequence(F.lit(0), F.expr(f"(size(words) - 1) div {block}").cast("int"))
    df = df.withColumn("blocks", F.transform(starts, lambda k: F.slice("words", k * block + 1, F.lit(block))))
    df = df.withColumn("heads", F.aggregate(F.transform("blocks", total), zero, grow))
    inner = F.flatten(F.transform("blocks", lambda b: F.slice(F.aggregate(b, zero, grow), F.lit(2), F.lit(block))))
    return df.withColumn("before", F.concat(zero, F.transform(inner, lambda x, i: x + F.get("heads", (i / block).cast("int"))))).drop("blocks", "heads")


def _short_runs(long_words: int) -> Column:
    """(first, last) of the shortest runs of over long_words words from and to each line, and of all lines."""
    n = F.size("before")
    halvings = F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double") + 1)).cast("int"))

    def at_most(x: Column) -> Column:
        """How many entries of ``before`` are x or less."""
        mid = lambda s: F.shiftright(s["lo"] + s["hi"], 1)
        halve = lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get("before", mid(s)) <= x, F.struct((mid(s) + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid(s).alias("hi")))
        return F.aggregate(halvings, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda s: s["lo"])

    lines = F.sequence(F.lit(0), n - 2)
    starting = F.transform(lines, lambda i: _span(i, at_most(F.get("before", i) + long_words) - 1))
    ending = F.transform(lines, lambda i: _span(at_most(F.get("before", i + 1) - long_words - 1) - 1, i))
    inside = F.filter(F.concat(starting, ending), lambda r: (r["first"] >= 0) & (r["last"] < n - 1))
    return F.concat(inside, F.array(_span(F.lit(0), n - 2)))


def candidates(docs: DataFrame, *, window: int = WINDOW, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """(doc_id, text_hash, found: array of (first, last, h)) of docs (doc_id, text): the runs of lines
    that go where they occur earlier, by line number from 0, and a hash of their lines."""
    got = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split("text", "\n").alias("lines"))
    got = got.withColumns({"cut_by": F.transform("lines", _line_hash), "h": F.transform("lines", lambda x: F.xxhash64(x)), "words": F.transform("lines", _n_words)}).drop("lines")

    def ends(i: Column) -> Column:
        rolled = F.get("cut_by", i)
        for back in range(1, window):
            rolled = rolled + F.coalesce(F.get("cut_by", i - back), F.lit(0)) * (31**back)
        return (rolled % _MODULUS % divisor == 0) | (F.get("words", i) > long_words) | F.coalesce(F.get("words", i + 1) > long_words, F.lit(True))

    got = got.withColumn("ends", F.filter(F.sequence(F.lit(0), F.size("h") - 1), ends))
    cut = F.transform("ends", lambda e, i: _span(F.coalesce(F.get("ends", i - 1) + 1, F.lit(0)), e))
    chunks = F.filter(cut, lambda c: (c["last"] > c["first"]) | (F.get("words", c["last"]) > long_words))
    got = _with_words_before(got.withColumn("chunks", chunks).drop("cut_by", "ends"))
    got = got.withColumn("runs", F.array_distinct(F.concat("chunks", _short_runs(long_words))))
    hashed = lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"), _run_hash(F.slice("h", r["first"] + 1, r["last"] - r["first"] + 1)).alias("h"))
    return got.select("doc_id", "text_hash", F.transform("runs", hashed).alias("found"))


def _runs_of(covered: str) -> Column:
    """(first, last) of the runs of adjacent numbers in a sorted array."""
    edge = lambda step: F.filter(covered, lambda x, i: F.coalesce(F.get(covered, i + step) != x + step, F.lit(True)))
    return F.arrays_zip(F.filter(covered, lambda x, i: (i == 0) | (F.get(covered, F.greatest(i - 1, F.lit(0))) != x - 1)).alias("first"), edge(1).alias("last"))


def repeats(cut: DataFrame) -> DataFrame:
    """From ``candidates`` the longest runs (doc_id, text_hash, firsts: array, n lines) that occur
    earlier at k_first of the document (k_id, k_hash), as far as hashes tell."""
    one = cut.select("doc_id", "text_hash", F.explode("found").alias("c")).select("doc_id", "text_hash", "c.*")
    place = F.struct("doc_id", "text_hash", "first")
    kept = one.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("kept")).where("n > 1")
    kept = materialise(kept.select(F.col("h").alias("same"), F.col("kept.doc_id").alias("k_id"), F.col("kept.text_hash").alias("k_hash"), F.col("kept.first").alias("k_first")), "line-kept")
    later = one.join(kept.hint("merge"), F.col("h") == F.col("same"))
    # a run does not repeat one that it overlaps, such as itself
    own = F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("text_hash") == F.col("k_hash"))
    later = later.where(~(own & (F.col("k_first") + F.col("last") - F.col("first") >= F.col("first"))))
    shifted = later.groupBy("doc_id", "text_hash", "k_id", "k_hash", (F.col("first") - F.col("k_first")).alias("shift")).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["last"])))))
    runs = shifted.withColumn("covered", covered).withColumn("r", F.explode(_runs_of("covered")))
    runs = runs.select("doc_id", "text_hash", "k_id", "k_hash", (F.col("r.first") - F.col("shift")).alias("k_first"), (F.col("r.last") - F.col("r.first") + 1).alias("n"), "r.first")
    return runs.groupBy("doc_id", "text_hash", "k_id", "k_hash", "k_first", "n").agg(F.collect_list("first").alias("firsts"))


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", info: str = "line_dedup", window: int = WINDOW, divisor: int = DIVISOR, long_words: int = LONG_WORDS) -> DataFrame:
    """docs with the removed lines taken out of ``text``, and the columns n_lines,
    n_removed_lines and n_removed_runs (of adjacent removed lines) in a struct ``info``.

    Removed are chunks of two or more lines, chunks of one long line, and runs of over
    long_words words, where they occur earlier, and every copy of an earlier document.
    A null text stays null, with no lines; an empty one is one empty line, so a later
    empty document counts as a copy with one line removed, and stays empty. A document
    whose every line goes has an empty text. Rows with equal id and text (a null id is
    an id too) lose the same lines. Ties between documents go by the text's hash. Texts
    may have any number of lines of any length. An empty table gives no rows. All other
    columns, whatever their names, pass through; where ``info`` is the name of one, the
    struct's gets underscores until it is not.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names)
    own_id, own_text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    plain = inner.select(own_id.alias("doc_id"), own_text.alias("text")).where("text is not null")
    runs = materialise(repeats(materialise(candidates(plain, window=window, divisor=divisor, long_words=long_words), "line-runs")), "line-repeats")

    def part(lines: str, first: Column, n: Column) -> Column:
        return F.array_join(F.slice(lines, first + 1, n), "\n")

    spans = runs.groupBy("k_id", "k_hash").agg(F.collect_set(F.struct("k_first", "n")).alias("spans"))
    sources = plain.withColumn("hash", F.xxhash64("text")).join(spans.hint("merge"), (F.col("hash") == F.col("k_hash")) & F.col("doc_id").eqNullSafe(F.col("k_id")))
    sources = sources.select("k_id", "k_hash", F.split("text", "\n").alias("lines"), F.explode("spans").alias("s"))
    sources = sources.select("k_id", "k_hash", "s.k_first", "s.n", part("lines", F.col("s.k_first"), F.col("s.n")).alias("run"))
    sources = materialise(sources.groupBy("k_id", "k_hash", "k_first", "n").agg(F.first("run").alias("run")).toDF("s_id", "s_hash", "s_first", "s_n", "run"), "line-sources")
    claims = runs.join(sources.hint("merge"), F.col("k_id").eqNullSafe(F.col("s_id")) & (F.col("k_hash") == F.col("s_hash")) & (F.col("k_first") == F.col("s_first")) & (F.col("n") == F.col("s_n")))
    claims = claims.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("firsts", "n", "run")).alias("claims"))

    keyed = inner.withColumn("hash", F.when(own_text.isNotNull(), F.xxhash64(own_text)))
    both = keyed.join(claims.hint("merge"), (F.col("hash") == F.col("text_hash")) & own_id.eqNullSafe(F.col("doc_id")), "left")
    both = both.withColumn("lines", F.split(own_text, "\n"))
    # only runs whose bytes are those of the first occurrence go
    proven = lambda c: F.transform(F.filter(c["firsts"], lambda f: part("lines", f, c["n"]) == c["run"]), lambda f: F.sequence(f, f + c["n"] - 1))
    dropped = F.array_sort(F.array_distinct(F.flatten(F.flatten(F.transform("claims", proven)))))
    both = both.withColumn("dropped", F.coalesce(dropped, F.array().cast("array<int>")))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "dropped"), lambda i: F.get("lines", i))
    text = F.when(F.size("dropped") == 0, own_text).otherwise(F.array_join(left, "\n"))
    counts = F.struct(
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.size("dropped").cast("long").alias("n_removed_lines"),
        F.size(_runs_of("dropped")).cast("long").alias("n_removed_runs"),
    )
    out = both.select(*[text if c == text_col else F.col(n) for c, n in zip(docs.columns, names, strict=True)], counts)
    return out.toDF(*docs.columns, free_name(docs.columns, info))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "line_dedup.n_lines", "line_dedup.n_removed_lines", "line_dedup.n_removed_runs", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


#: The same candidates and the same rule in SQL, over rows of lines.
OP10_SQL = f"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM docs),
lines AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h,
    len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words
  FROM split),
flagged AS (
  SELECT *, words > {LONG_WORDS} AS long, sum(words) OVER w AS after, sum(words) OVER w - words AS before,
    (h + coalesce(lag(h) OVER w, 0) * 31) % {_MODULUS} % {DIVISOR} = 0 OR words > {LONG_WORDS} OR coalesce(lead(words) OVER w > {LONG_WORDS}, true) AS ends
  FROM lines WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id, text ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM flagged),
chunks AS (SELECT doc_id, text, min(i) AS first, max(i) AS last FROM numbered GROUP BY doc_id, text, k HAVING count(*) > 1 OR bool_or(long)),
reach AS (SELECT doc_id, text, after, min(i) AS last FROM flagged GROUP BY doc_id, text, after),
leave AS (SELECT doc_id, text, before, max(i) AS first FROM flagged GROUP BY doc_id, text, before),
runs AS (
  SELECT * FROM chunks
  UNION SELECT f.doc_id, f.text, f.i, r.last FROM flagged f ASOF JOIN reach r ON f.doc_id = r.doc_id AND f.text = r.text AND f.before + {LONG_WORDS} + 1 <= r.after
  UNION SELECT f.doc_id, f.text, l.first, f.i FROM flagged f ASOF JOIN leave l ON f.doc_id = l.doc_id AND f.text = l.text AND f.after - {LONG_WORDS} - 1 >= l.before
  UNION SELECT doc_id, text, 0, max(i) FROM lines GROUP BY doc_id, text),
named AS (SELECT *, array_to_string(list_slice(string_split(text, chr(10)), first + 1, last + 1), chr(10)) AS run, last - first AS size FROM runs),
ranked AS (SELECT *, first_value({{'d': doc_id, 't': md5(text), 'f': first}}) OVER (PARTITION BY run, size ORDER BY doc_id, md5(text), first) AS kept FROM named),
gone AS (
  SELECT DISTINCT doc_id, text, unnest(range(first, last + 1)) AS i FROM ranked
  WHERE NOT (doc_id = kept.d AND md5(text) = kept.t AND kept.f + size >= first)),
starts AS (SELECT doc_id, text, count(*) AS n, count(*) FILTER (WHERE NOT follows) AS runs FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id, text ORDER BY i) = i - 1, false) AS follows FROM gone) GROUP BY doc_id, text),
kept AS (
  SELECT l.doc_id, l.text, string_agg(l.line, chr(10) ORDER BY l.i) AS new_text
  FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.text = g.text AND l.i = g.i GROUP BY l.doc_id, l.text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
  coalesce(s.n, 0)::BIGINT AS n_removed_lines, coalesce(s.runs, 0)::BIGINT AS n_removed_runs, md5(coalesce(k.new_text, '')) AS text_md5
FROM documents d LEFT JOIN starts s ON d.doc_id = s.doc_id AND d.text = s.text LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""

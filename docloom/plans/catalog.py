"""Registry of the library's queries and their DuckDB SQL; each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import codecs, issues, objects, text
from docloom.operators import compare, diff, forms, pageset, profile, revisions, trees
from docloom.scratch import shuffle_width
from docloom.streaming import revisions as streaming

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT source, count(*) AS n_docs, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS text_bytes,
  max(octet_length(encode(coalesce(text, ''))))::BIGINT AS longest, bool_or(coalesce(text, '') <> '') AS has_text FROM documents GROUP BY source""")
def doc_summary(spark, d):
    return profile.text_profile(table(spark, d, "documents"), "source")


_CASE = f"translate(text, '{text.UPPER}', '{text.LOWER}')"


@query(f"SELECT doc_id, md5({_CASE}) AS digest FROM documents")
def normalize_case(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.fold_case(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(regexp_replace(text, '[ \\t\\n\\r]', '', 'g')) AS digest FROM documents")
def normalize_ws(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.strip_space(F.col("text"))).alias("digest"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS word FROM documents) GROUP BY word")
def split_words(spark, d):
    return table(spark, d, "documents").select(F.explode(text.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT a.conv_id, a.turn, regexp_extract_all(hex(encode(a.text)), '..') AS x, regexp_extract_all(hex(encode(b.text)), '..') AS y
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, CASE WHEN greatest(len(x), len(y)) = 0 THEN 0.0 ELSE
  list_sum(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: CASE WHEN x[i] IS NOT DISTINCT FROM y[i] THEN 0 ELSE 1 END))::DOUBLE / greatest(len(x), len(y)) END AS ratio FROM p""")
def change_ratio(spark, d):
    c = table(spark, d, "conversations")
    a = c.select("conv_id", "turn", F.col("text").alias("a"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", text.change_ratio(F.col("a"), F.col("b")).alias("ratio"))


@query("""WITH c AS (SELECT conv_id, turn, text FROM conversations), m AS (SELECT max(conv_id) AS top FROM c),
l AS (SELECT conv_id AS pair, turn, text FROM c), r AS (SELECT conv_id - 1 AS pair, turn, text FROM c)
SELECT coalesce(l.pair, r.pair) AS pair, coalesce(l.turn, r.turn) AS turn,
  CASE WHEN l.pair IS NULL THEN 'added' WHEN r.pair IS NULL THEN 'removed' WHEN l.text IS NOT DISTINCT FROM r.text THEN 'equal' ELSE 'modified' END AS category
FROM l FULL JOIN r ON l.pair = r.pair AND l.turn = r.turn""")
def diff_pages_positional(spark, d):
    c = table(spark, d, "conversations")
    left, right = c.withColumn("pair", F.col("conv_id")), c.withColumn("pair", F.col("conv_id") - 1)
    return diff.keyed_diff(left, right, ["pair", "turn"], "text").select("pair", "turn", "category")


_FORM = "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE year(o_orderdate) % 2 = {} GROUP BY ALL"


@query(f"""SELECT coalesce(l.o_custkey, r.o_custkey) AS o_custkey, coalesce(l.o_orderpriority, r.o_orderpriority) AS o_orderpriority, l.n AS old_value, r.n AS new_value,
  CASE WHEN l.n IS NULL THEN 'added' WHEN r.n IS NULL THEN 'removed' WHEN l.n = r.n THEN 'equal' ELSE 'modified' END AS category
FROM ({_FORM.format(0)}) l FULL JOIN ({_FORM.format(1)}) r ON l.o_custkey = r.o_custkey AND l.o_orderpriority = r.o_orderpriority""")
def diff_forms_by_name(spark, d):
    o = table(spark, d, "orders")
    side = lambda k: o.filter(F.year("o_orderdate") % 2 == k).groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return diff.keyed_diff(side(0), side(1), ["o_custkey", "o_orderpriority"], "n")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE sha256(b.text) = sha256(d.text))")
def diff_added(spark, d):
    key = lambda t: table(spark, d, t).withColumn("digest", F.sha2("text", 256))
    return diff.added(key("benchmark"), key("documents"), ["digest"]).select("doc_id")


@query("SELECT item_id FROM benchmark b WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE sha256(b.text) = sha256(d.text))")
def diff_removed(spark, d):
    key = lambda t: table(spark, d, t).withColumn("digest", F.sha2("text", 256))
    return diff.removed(key("benchmark"), key("documents"), ["digest"]).select("item_id")


_GRAPHIC = "concat_ws(':', floor(l_quantity * 10 + 0.5)::BIGINT, floor(l_extendedprice * 10 + 0.5)::BIGINT, floor(l_discount * 10 + 0.5)::BIGINT, floor(l_tax * 10 + 0.5)::BIGINT)"


@query(f"""WITH g AS (SELECT {_GRAPHIC} AS key, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL),
l AS (SELECT key, n FROM g WHERE l_linestatus = 'F'), r AS (SELECT key, n FROM g WHERE l_linestatus = 'O')
SELECT coalesce(l.key, r.key) AS key, CASE WHEN l.n IS NULL THEN 'added' WHEN r.n IS NULL THEN 'removed' WHEN l.n = r.n THEN 'equal' ELSE 'modified' END AS category
FROM l FULL JOIN r ON l.key = r.key""")
def diff_graphics_key(spark, d):
    key = text.rounded_key(*map(F.col, ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
    g = table(spark, d, "lineitem").groupBy(key.alias("key"), "l_linestatus").agg(F.count("*").alias("n"))
    return diff.keyed_diff(g.filter("l_linestatus = 'F'"), g.filter("l_linestatus = 'O'"), ["key"], "n").select("key", "category")


@query("""SELECT a.p_partkey AS a_key, b.p_partkey AS b_key FROM part a JOIN part b
ON a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND abs(a.p_retailprice - b.p_retailprice) < 1.0""")
def band_match(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("a_key"), F.col("p_size").alias("a_size"), F.col("p_retailprice").alias("a_price"))
    b = p.select(F.col("p_partkey").alias("b_key"), F.col("p_size").alias("b_size"), F.col("p_retailprice").alias("b_price"))
    return diff.band_match(a, b, [("a_size", "b_size")], "a_price", "b_price", 1.0).filter("a_key < b_key").select("a_key", "b_key")


@query("""WITH f AS (SELECT sha256(text) AS h, min(doc_id) AS first_id FROM documents GROUP BY 1)
SELECT d.doc_id, f.first_id FROM documents d JOIN f ON sha256(d.text) = f.h WHERE d.doc_id > f.first_id""")
def image_equal_moved(spark, d):
    return diff.moved(table(spark, d, "documents").select("doc_id", "text"), F.sha2("text", 256), "doc_id", "first_id").select("doc_id", "first_id")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) = 1""")
def best_score_match(spark, d):
    return diff.best_match(table(spark, d, "lineitem"), "l_linenumber", "l_orderkey", "l_extendedprice")


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_wins(spark, d):
    return revisions.latest_wins(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value", "event_id"])


@query("""SELECT user_id, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events
WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id""")
def as_of_revision(spark, d):
    return revisions.as_of(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ["value", "event_id"], F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp"))


@query("SELECT event_id, user_id, epoch_us(ts) AS end_us, epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS start_us FROM events")
def revision_bounds(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("end_us"))
    return revisions.bounds(e, ["user_id"], ["ts", "event_id"], "end_us", "start_us").drop("ts")


@query("SELECT md5(text) AS digest, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def first_wins_distinct(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("digest"), "doc_id", "source")
    return revisions.first_wins(docs, ["digest"], ["doc_id"], ["doc_id", "source"])


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_number FROM conversations")
def page_numbering(spark, d):
    return pageset.number_pages(table(spark, d, "conversations").select("conv_id", "turn"), ["conv_id"], ["turn"])


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
_NUMBERED = f"(SELECT page_id, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS page_number FROM pages)"


def _hosted(spark, d) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))
    return pageset.number_pages(p, ["host"], ["page_id"])


@query(f"SELECT *, ((page_number + 4) // 5)::BIGINT AS part FROM {_NUMBERED}")
def split_by_count(spark, d):
    return pageset.split_by_count(_hosted(spark, d), 5)


@query(f"SELECT n.*, r.part FROM {_NUMBERED} n JOIN (VALUES (1::BIGINT, 1, 3), (2, 2, 5), (3, 8, 20)) r(part, a, b) ON n.page_number BETWEEN r.a AND r.b")
def split_ranges(spark, d):
    return pageset.split_ranges(_hosted(spark, d), [(1, 3), (2, 5), (8, 20)])


@query(f"SELECT n.*, w.new_number FROM {_NUMBERED} n JOIN (VALUES (5, 1::BIGINT), (1, 2), (3, 3), (1, 4)) w(p, new_number) ON n.page_number = w.p")
def extract_pages(spark, d):
    return pageset.extract_pages(_hosted(spark, d), [5, 1, 3, 1])


@query(f"SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_number) AS new_number FROM {_NUMBERED} WHERE page_number NOT IN (2, 4, 7)")
def delete_pages(spark, d):
    return pageset.delete_pages(_hosted(spark, d), [7, 2, 4])


@query(f"""SELECT page_id, host, page_number, page_number + (page_number >= 2)::BIGINT AS new_number FROM {_NUMBERED}
UNION ALL SELECT NULL, host, NULL, 2 FROM (SELECT DISTINCT {_HOST} AS host FROM pages)""")
def insert_page(spark, d):
    p = _hosted(spark, d)
    return pageset.insert_page(p, 2, p.select("host").distinct())


@query("SELECT page_id, (((page_id % 4) * 90 + 270) % 360)::BIGINT AS rotation FROM pages")
def rotate(spark, d):
    return table(spark, d, "pages").select("page_id", pageset.rotate((F.col("page_id") % 4) * 90, 270).cast("long").alias("rotation"))


@query("""WITH a AS (SELECT max(r_regionkey) AS t FROM region), b AS (SELECT max(n_nationkey) AS t FROM nation)
SELECT 1::BIGINT AS file_no, r_name AS name, r_regionkey::BIGINT AS number, r_regionkey::BIGINT AS new_number FROM region
UNION ALL SELECT 2, n_name, n_nationkey, n_nationkey + (SELECT t FROM a) FROM nation
UNION ALL SELECT 3, s_name, s_suppkey, s_suppkey + (SELECT t FROM a) + (SELECT t FROM b) FROM supplier""")
def merge_renumber(spark, d):
    take = lambda t, c: table(spark, d, t).select(F.col(f"{c}_name").alias("name"), F.col({"r": "r_regionkey", "n": "n_nationkey", "s": "s_suppkey"}[c]).cast("long").alias("number"))
    return pageset.merge_renumber([take("region", "r"), take("nation", "n"), take("supplier", "s")], "number")


@query("""SELECT 'r' || r_regionkey AS node, r_name AS full_name, 0::BIGINT AS depth FROM region
UNION ALL SELECT 'n' || n_nationkey, r_name || '.' || n_name, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 's' || s_suppkey, r_name || '.' || n_name || '.' || s_name, 2 FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def full_name_tree(spark, d):
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = (
        table(spark, d, "region").select(key("r", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("name"))
        .unionByName(table(spark, d, "nation").select(key("n", "n_nationkey").alias("node"), key("r", "n_regionkey").alias("parent"), F.col("n_name").alias("name")))
        .unionByName(table(spark, d, "supplier").select(key("s", "s_suppkey").alias("node"), key("n", "s_nationkey").alias("parent"), F.col("s_name").alias("name")))
    )
    return trees.full_names(nodes, "node", "parent", "name").select("node", "full_name", "depth")


@query("SELECT doc_id FROM documents WHERE text IS NULL OR text = ''")
def validate_required(spark, d):
    return forms.required_empty(table(spark, d, "documents"), "text").select("doc_id")


@query("""SELECT c_custkey, CASE WHEN octet_length(encode(c_name)) < 5 THEN 'min_length' WHEN octet_length(encode(c_name)) > 15 THEN 'max_length' END AS failure FROM customer""")
def validate_length(spark, d):
    return table(spark, d, "customer").select("c_custkey", forms.first_failure(F.col("c_name"), min_length=5, max_length=15).alias("failure"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'minimum' WHEN c_acctbal > 5000 THEN 'maximum' END AS failure FROM customer")
def validate_range(spark, d):
    return table(spark, d, "customer").select("c_custkey", forms.first_failure(F.col("c_acctbal"), minimum=0, maximum=5000).alias("failure"))


@query("SELECT p_partkey, CASE WHEN NOT regexp_matches(p_brand, '[0-4]$') THEN 'pattern' END AS failure FROM part")
def validate_pattern(spark, d):
    return table(spark, d, "part").select("p_partkey", forms.first_failure(F.col("p_brand"), pattern="[0-4]$").alias("failure"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'option' END AS failure FROM orders")
def validate_option(spark, d):
    return table(spark, d, "orders").select("o_orderkey", forms.first_failure(F.col("o_orderstatus"), options=["O", "F"]).alias("failure"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def validate_missing(spark, d):
    return forms.missing_fields(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), ["doc_id"])


@query("SELECT doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE l.doc_id = d.doc_id)")
def validate_unknown(spark, d):
    return forms.unknown_fields(table(spark, d, "labels"), table(spark, d, "documents"), ["doc_id"]).select("doc_id")


@query("""SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'O' AND o_totalprice > 100000) OR NOT starts_with(o_orderpriority, '1')""")
def condition_filter(spark, d):
    rule = {"logic": "OR", "of": [
        {"logic": "AND", "of": [{"op": "equals", "field": "o_orderstatus", "value": "O"}, {"op": "greaterThan", "field": "o_totalprice", "value": 100000}]},
        {"logic": "NOT", "of": [{"op": "startsWith", "field": "o_orderpriority", "value": "1"}]},
    ]}
    return table(spark, d, "orders").filter(forms.condition(rule)).select("o_orderkey")


_K = "json_extract_string(props, '$.k')"
_FLOAT = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'"


@query(f"""SELECT event_id, CASE WHEN coalesce({_K}, '') = '' THEN 'empty' WHEN lower({_K}) IN ('true', 'false', '1', '0') THEN 'bool'
WHEN regexp_matches({_K}, '^[+-]?[0-9]+$') THEN 'int' WHEN regexp_matches({_K}, {_FLOAT}) THEN 'float' ELSE 'string' END AS kind FROM events""")
def infer_value_type(spark, d):
    return table(spark, d, "events").select("event_id", text.value_type(F.get_json_object("props", "$.k")).alias("kind"))


@query(f"""SELECT event_id, CASE WHEN coalesce({_K}, '') = '' THEN 'empty' WHEN regexp_matches({_K}, {_FLOAT}) THEN 'float'
WHEN lower({_K}) IN ('true', 'false') THEN 'bool' ELSE 'string' END AS kind FROM events""")
def infer_style_type(spark, d):
    return table(spark, d, "events").select("event_id", text.style_type(F.get_json_object("props", "$.k")).alias("kind"))


_ID = "regexp_replace(regexp_replace({}, '[ -]', '_', 'g'), '[^A-Za-z0-9_]', '', 'g')"


@query(f"""SELECT p_partkey, CASE WHEN i = '' THEN 'field_' || p_partkey WHEN regexp_matches(i, '^[0-9]') THEN 'field_' || i ELSE i END AS field_id
FROM (SELECT p_partkey, {_ID.format("p_size || '-' || p_name")} AS i FROM part)""")
def sanitize_id(spark, d):
    return table(spark, d, "part").select("p_partkey", text.sanitise_id(F.concat(F.col("p_size").cast("string"), F.lit("-"), F.col("p_name")), F.col("p_partkey")).alias("field_id"))


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'button' WHEN 'view' THEN 'text' WHEN 'purchase' THEN 'number' ELSE 'none' END AS kind FROM events")
def map_response_type(spark, d):
    return table(spark, d, "events").select("event_id", text.response_type(F.col("event_type"), {"click": "button", "view": "text", "purchase": "number"}, "none").alias("kind"))


_ESC = r"replace(replace(replace(replace(replace(replace(text, '\', '\\'), '(', '\('), ')', '\)'), chr(13), '\r'), chr(10), '\n'), chr(9), '\t')"


@query(f"SELECT doc_id, md5({_ESC}) AS digest FROM documents")
def pdf_escape(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.escape_string(F.col("text"))).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def pdf_unescape(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.unescape_string(text.escape_string(F.col("text")))).alias("digest"))


@query("SELECT o_orderkey, strftime(o_orderdate, 'D:%Y%m%d%H%M%S') AS pdf_date FROM orders")
def pdf_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", text.pdf_date(F.col("o_orderdate")).alias("pdf_date"))


@query("SELECT p_partkey, p_name AS name, replace(p_brand, '#', '') AS brand, p_size::VARCHAR AS size, NULL::VARCHAR AS missing FROM part")
def dict_value(spark, d):
    """Each part as the text of a dictionary object, and its entries read back."""
    brand = F.concat(F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")))
    raw = F.concat(F.lit("<< /Name ("), text.escape_string(F.col("p_name")), F.lit(") % a comment\n/Brand "), brand, F.lit(" /Kids [<< /Size 7 >>] /Size "), F.col("p_size").cast("string"), F.lit(" >>"))
    # Dealt by key, as a file of few bytes is one task's split however much work its rows are.
    parts = table(spark, d, "part").repartition(shuffle_width(spark), "p_partkey").select("p_partkey", raw.alias("raw"))
    got = parts.select("p_partkey", objects.dict_values(F.col("raw"), ["Name", "Brand", "Size", "Missing"]).alias("v"))
    return got.select("p_partkey", *[F.col("v")[i].alias(n) for i, n in enumerate(("name", "brand", "size", "missing"))])


@query("SELECT n_nationkey, unnest([n_nationkey, n_regionkey + 100, n_nationkey + 1000])::BIGINT AS ref FROM nation")
def refs(spark, d):
    raw = F.format_string("<< /A %d 0 R /B [(1 0 R) << /C %d 0 R >> %d 0 R] /D 5 >>", F.col("n_nationkey").cast("int"), (F.col("n_regionkey") + 100).cast("int"), (F.col("n_nationkey") + 1000).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", F.explode(objects.refs(raw)).alias("ref"))


@query("SELECT doc_id, md5(hex(encode(text)) || '>') AS digest FROM documents")
def ascii_hex(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(codecs.encoded(F.encode("text", "UTF-8"), "ASCIIHexDecode")).alias("digest"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def digest(spark, d):
    return table(spark, d, "documents").select("doc_id", objects.digests(F.encode("text", "UTF-8")).alias("x")).select("doc_id", "x.*")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def ascii_hex_decode(spark, d):
    """Texts as hexadecimal digits in either case, in lines, with what stands behind the end mark."""
    digits = F.hex(F.encode("text", "UTF-8"))
    lines = F.regexp_replace(F.when(F.col("doc_id") % 2 == 0, F.lower(digits)).otherwise(digits), "(.{72})", "$1\n")
    data = F.encode(F.concat(lines, F.lit(" > 00")), "UTF-8")
    return table(spark, d, "documents").select("doc_id", F.md5(codecs.decoded(data, "AHx")).alias("digest"))


def _round_trip(spark, d, name: str) -> DataFrame:
    data = F.encode("text", "UTF-8")
    return table(spark, d, "documents").select("doc_id", F.md5(codecs.decoded(codecs.encoded(data, name), name)).alias("digest"))


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def ascii85_roundtrip(spark, d):
    return _round_trip(spark, d, "ASCII85Decode")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def runlength_roundtrip(spark, d):
    return _round_trip(spark, d, "RunLengthDecode")


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def flate_roundtrip(spark, d):
    return _round_trip(spark, d, "FlateDecode")


@query("SELECT event_type AS code, CASE WHEN value < 10 THEN 'info' WHEN value < 50 THEN 'warning' ELSE 'error' END AS level, count(*) AS n FROM events GROUP BY ALL")
def warnings_by_level(spark, d):
    level = F.when(F.col("value") < 10, "info").when(F.col("value") < 50, "warning").otherwise("error")
    return issues.level_counts(table(spark, d, "events").select(F.col("event_type").alias("code"), level.alias("level")))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'not_found' WHEN 'view' THEN 'validation' WHEN 'purchase' THEN 'encryption' ELSE 'other' END AS class,
  event_type = 'click' AS not_found, user_id::VARCHAR AS who FROM events""")
def error_class(spark, d):
    code = text.response_type(F.col("event_type"), {"click": "no_field", "view": "maximum", "purchase": "wrong_password"}, "unheard_of")
    e = table(spark, d, "events").withColumn("code", code).withColumn("context", issues.with_context(F.create_map(F.lit("who"), F.lit("nobody")), "who", F.col("user_id")))
    return e.select("event_id", issues.error_class(F.col("code")).alias("class"), issues.is_class(F.col("code"), "not_found").alias("not_found"), F.col("context")["who"].alias("who"))


@query(f"""WITH l AS (SELECT o_custkey AS pair_id, category, count(*) AS n FROM ({SQL['diff_forms_by_name']}) WHERE category <> 'equal' GROUP BY ALL)
SELECT c.o_custkey::VARCHAR AS pair_id, coalesce(sum(l.n), 0) = 0 AS identical,
  'differences: ' || coalesce(sum(l.n), 0)::BIGINT || coalesce(string_agg(chr(10) || 'field ' || l.category || ': ' || l.n, '' ORDER BY l.category), '') AS report
FROM (SELECT DISTINCT o_custkey FROM orders) c LEFT JOIN l ON c.o_custkey = l.pair_id GROUP BY c.o_custkey""")
def report_lines(spark, d):
    found = diff_forms_by_name(spark, d).filter("category <> 'equal'").select(F.col("o_custkey").cast("string").alias("pair_id"), F.lit("field").alias("kind"), "category")
    return compare.report(table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("pair_id")), found)


def _events(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))


@query("SELECT date_trunc('day', ts)::VARCHAR AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_tumbling(spark, d):
    got = streaming.windowed_counts(_events(spark, d), "ts", ["event_type"])
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("""SELECT (date_trunc('day', ts - INTERVAL 12 HOUR * k) + INTERVAL 12 HOUR * k)::VARCHAR AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1)) s(k) GROUP BY ALL""")
def window_sliding(spark, d):
    got = streaming.sliding_counts(_events(spark, d), "ts", ["event_type"])
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def window_session(spark, d):
    got = streaming.session_counts(_events(spark, d), "ts", ["user_id"], "6 hours")
    return got.select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("SELECT user_id, event_type, min(epoch_us(ts)) AS ts_us FROM events GROUP BY ALL")
def first_seen(spark, d):
    return streaming.first_seen(_events(spark, d), "ts", ["user_id", "event_type"]).select("user_id", "event_type", F.unix_micros("ts").alias("ts_us"))


def _turns(spark, d, shift: int) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select((F.col("conv_id") - shift).alias("pair"), F.col("turn").alias("idx"), "text", F.lit(72.0).alias("x"), (720 - 10 * F.col("turn")).cast("double").alias("y"), F.col("role").alias("font_name"), F.lit(12.0).alias("font_size"))


#: Both sides' rows stand at one place if they are of one turn. {p}: the text as it is compared; {moves}: whether moves are told.
_ALIGN = """WITH RECURSIVE l0 AS (SELECT conv_id AS pair, turn AS idx, text, role AS font, {p} AS p FROM conversations), r0 AS (SELECT conv_id - 1 AS pair, turn AS idx, text, role AS font, {p} AS p FROM conversations),
same AS (SELECT pair, idx FROM l0 JOIN r0 USING (pair, idx) WHERE l0.p IS NOT DISTINCT FROM r0.p),
l1 AS (SELECT * FROM l0 ANTI JOIN same USING (pair, idx)), r1 AS (SELECT * FROM r0 ANTI JOIN same USING (pair, idx)),
changed AS (SELECT l1.pair, l1.idx FROM l1 JOIN r1 USING (pair, idx) WHERE NOT EXISTS (SELECT 1 FROM r1 o WHERE o.pair = l1.pair AND o.p = l1.p) AND NOT EXISTS (SELECT 1 FROM l1 o WHERE o.pair = r1.pair AND o.p = r1.p)),
l2 AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY idx) AS k FROM l1 ANTI JOIN changed USING (pair, idx)), r2 AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY idx) AS k FROM r1 ANTI JOIN changed USING (pair, idx)),
size AS (SELECT pair, n, m FROM (SELECT pair, count(*) AS n FROM l2 GROUP BY pair) JOIN (SELECT pair, count(*) AS m FROM r2 GROUP BY pair) USING (pair)),
grid(pair, q, t) AS (SELECT pair, 0::BIGINT, []::BIGINT[] FROM size UNION ALL
  SELECT g.pair, q + 1, list_append(t, CASE WHEN q // (m + 1) = 0 OR q % (m + 1) = 0 THEN 0 WHEN a.p = b.p AND a.font = b.font THEN t[q - m - 1] + 1 ELSE greatest(t[q - m], t[q]) END)
  FROM grid g JOIN size z ON z.pair = g.pair LEFT JOIN l2 a ON a.pair = g.pair AND a.k = q // (m + 1) LEFT JOIN r2 b ON b.pair = g.pair AND b.k = q % (m + 1) WHERE q < (n + 1) * (m + 1)),
walk(pair, i, j, hit) AS (SELECT pair, n, m, false FROM size UNION ALL
  SELECT w.pair, CASE WHEN a.p = b.p AND a.font = b.font OR t[(i - 1) * (m + 1) + j + 1] > t[i * (m + 1) + j] THEN i - 1 ELSE i END,
    CASE WHEN NOT (a.p = b.p AND a.font = b.font) AND t[(i - 1) * (m + 1) + j + 1] > t[i * (m + 1) + j] THEN j ELSE j - 1 END, a.p = b.p AND a.font = b.font
  FROM walk w JOIN size z ON z.pair = w.pair JOIN grid g ON g.pair = w.pair AND g.q = (n + 1) * (m + 1) JOIN l2 a ON a.pair = w.pair AND a.k = i JOIN r2 b ON b.pair = w.pair AND b.k = j),
chain AS (SELECT w.pair, a.idx AS left_idx, b.idx AS right_idx FROM walk w JOIN l2 a ON a.pair = w.pair AND a.k = i + 1 JOIN r2 b ON b.pair = w.pair AND b.k = j + 1 WHERE hit),
l3 AS (SELECT *, row_number() OVER (PARTITION BY pair, p ORDER BY idx) AS nth FROM l2 WHERE NOT EXISTS (SELECT 1 FROM chain c WHERE c.pair = l2.pair AND c.left_idx = l2.idx)),
r3 AS (SELECT *, row_number() OVER (PARTITION BY pair, p ORDER BY idx) AS nth FROM r2 WHERE NOT EXISTS (SELECT 1 FROM chain c WHERE c.pair = r2.pair AND c.right_idx = r2.idx)),
moved AS (SELECT l3.pair, l3.idx AS left_idx, r3.idx AS right_idx FROM l3 JOIN r3 USING (pair, p, nth) WHERE {moves}),
l4 AS (SELECT * FROM l3 WHERE NOT EXISTS (SELECT 1 FROM moved c WHERE c.pair = l3.pair AND c.left_idx = l3.idx)), r4 AS (SELECT * FROM r3 WHERE NOT EXISTS (SELECT 1 FROM moved c WHERE c.pair = r3.pair AND c.right_idx = r3.idx)),
last AS (SELECT l4.pair, l4.idx FROM l4 JOIN r4 USING (pair, idx)),
found AS (SELECT pair, 'modified' AS kind, idx AS left_idx, idx AS right_idx FROM changed UNION ALL SELECT pair, 'modified', idx, idx FROM last
  UNION ALL SELECT pair, 'moved', left_idx, right_idx FROM chain WHERE {moves} AND left_idx <> right_idx UNION ALL SELECT pair, 'moved', left_idx, right_idx FROM moved
  UNION ALL SELECT pair, 'removed', idx, NULL FROM l4 ANTI JOIN last USING (pair, idx) UNION ALL SELECT pair, 'added', NULL, idx FROM r4 ANTI JOIN last USING (pair, idx)),
bytes AS (SELECT f.pair, f.kind, f.left_idx, f.right_idx, regexp_extract_all(hex(encode(l0.text)), '..') AS x, regexp_extract_all(hex(encode(r0.text)), '..') AS y
  FROM found f LEFT JOIN l0 ON l0.pair = f.pair AND l0.idx = left_idx LEFT JOIN r0 ON r0.pair = f.pair AND r0.idx = right_idx)
SELECT pair, kind, left_idx::BIGINT AS left_idx, right_idx::BIGINT AS right_idx, CASE kind WHEN 'moved' THEN 0.0 WHEN 'modified' THEN
  list_sum(list_transform(range(1, greatest(len(x), len(y)) + 1), lambda i: CASE WHEN x[i] IS NOT DISTINCT FROM y[i] THEN 0 ELSE 1 END))::DOUBLE / greatest(len(x), len(y)) ELSE 1.0 END AS ratio FROM bytes"""


def _aligned(spark, d, options: diff.CompareOptions) -> DataFrame:
    from docloom.operators import matching

    found = matching.align_sequences(_turns(spark, d, 0), _turns(spark, d, 1), ["pair"], options)
    c = table(spark, d, "conversations")
    found = found.join(c.select(F.col("conv_id").alias("pair"), F.col("turn").alias("left_idx"), F.col("text").alias("a")), ["pair", "left_idx"], "left")
    found = found.join(c.select((F.col("conv_id") - 1).alias("pair"), F.col("turn").alias("right_idx"), F.col("text").alias("b")), ["pair", "right_idx"], "left")
    ratio = F.when(F.col("kind") == "moved", 0.0).when(F.col("kind") == "modified", text.change_ratio(F.col("a"), F.col("b"))).otherwise(1.0)
    return found.select("pair", "kind", F.col("left_idx").cast("long").alias("left_idx"), F.col("right_idx").cast("long").alias("right_idx"), ratio.alias("ratio"))


@query(_ALIGN.format(p="text", moves="true"))
def greedy_diff(spark, d):
    return _aligned(spark, d, diff.CompareOptions())


@query(_ALIGN.format(p=f"regexp_replace({_CASE}, '[ \\t\\r\\n]', '', 'g')", moves="false"))
def lcs_match(spark, d):
    return _aligned(spark, d, diff.CompareOptions(ignore_case=True, ignore_space=True, detect_moves=False))


from docloom.plans import document_queries, sequence_queries  # noqa: E402, F401  register their queries here

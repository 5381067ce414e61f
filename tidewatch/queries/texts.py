"""Text and XML queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import text
from tidewatch.operators.joins import contains_join
from tidewatch.queries.registry import Tables, query


# The rules as the checking SQL applies them, innermost first.
FORM_STEPS = [
    ('([@>])"((SE[LT]|INS|UPD|DEL|MRG)\\$[0-9A-F_]+|APEX\\$INNER|G?V_[A-Z_]*)"', '\\1{qblk}'),
    ('"[A-Za-z_][A-Za-z0-9_$#]*"(\\."[A-Za-z_][A-Za-z0-9_$#]*")*', '{obj}'),
    ('\\{obj\\}@\\{qblk\\}', '{obj}'),
    ("'[^']*'", '{string}'),
    ('\\d+', '{number}'),
    ('\\(\\{number\\}\\s+\\{number\\}\\)', '{number_pair}'),
    ('\\{obj\\}(\\s+\\{obj\\})+', '{list_of_objects}'),
    ('\\{number_pair\\}(\\s+\\{number_pair\\})+', '{list_of_number_pairs}'),
    ('\\{number\\}(\\s+\\{number\\})+', '{list_of_numbers}'),
]


def _form_sql(expression: str) -> str:
    for pattern, replacement in FORM_STEPS:
        quoted = pattern.replace("'", "''")
        expression = f"regexp_replace({expression}, '{quoted}', '{replacement}', 'g')"
    return expression


FORMS_TAIL = """
SELECT form, nullif(regexp_extract(form, '^[A-Z][A-Z_]*'), '') AS keyword, min(hint) AS text_sample, min(id) AS id_sample,
  count(DISTINCT id) AS ids, true AS estimate_near FROM f GROUP BY form"""


def _checked(forms):
    """The estimate is compared with the exact count, as sketches differ between engines.

    Its relative error is 5 %, so 15 % is three deviations; in a small set two ids that share
    a register make a difference of one, whatever its share.
    """
    near = F.abs(F.col("ids_estimate") - F.col("ids")) <= 0.15 * F.col("ids") + 2
    return forms.withColumn("estimate_near", near).drop("ids_estimate")


@query("text_forms", f"WITH f AS (SELECT url AS hint, page_id AS id, {_form_sql('url')} AS form FROM pages) {FORMS_TAIL}")
def text_forms_query(t: Tables):
    return _checked(text.text_forms(t.pages, "url", "page_id", exact=True))


HINTS = """h AS (
  SELECT l_orderkey AS id, CASE l_returnflag
    WHEN 'A' THEN 'INDEX(@"SEL$' || l_linenumber || '" "PART"@"SEL$' || l_linenumber || '" ("PART"."P_PARTKEY" "PART"."P_SIZE"))'
    WHEN 'N' THEN 'OPT_PARAM(''q' || l_partkey || ''' ''x'') CARD((1 ' || l_linenumber || ') (2 ' || l_suppkey || ')) 7 8 9'
    ELSE 'LEADING(@"UPD$' || l_linenumber || '" "A"@"UPD$1" "B' || l_linestatus || '"@"UPD$1")' END AS hint
  FROM lineitem
)"""


def _hints(t: Tables):
    line, part, supp = (F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey"))
    q = F.lit
    index = F.concat(q('INDEX(@"SEL$'), line, q('" "PART"@"SEL$'), line, q('" ("PART"."P_PARTKEY" "PART"."P_SIZE"))'))
    card = F.concat(q("OPT_PARAM('q"), part, q("' 'x') CARD((1 "), line, q(") (2 "), supp, q(")) 7 8 9"))
    leading = F.concat(q('LEADING(@"UPD$'), line, q('" "A"@"UPD$1" "B'), F.col("l_linestatus"), q('"@"UPD$1")'))
    hint = F.when(F.col("l_returnflag") == "A", index).when(F.col("l_returnflag") == "N", card).otherwise(leading)
    return t.lineitem.select(F.col("l_orderkey").alias("id"), hint.alias("hint"))


@query("text_forms_hints", f"WITH {HINTS}, f AS (SELECT *, {_form_sql('hint')} AS form FROM h) {FORMS_TAIL}")
def text_forms_hints_query(t: Tables):
    return _checked(text.text_forms(_hints(t), "hint", "id", exact=True))


@query("xml_explode", """
SELECT event_id, user_id % 50 = 0 AS rejected,
  unnest(CASE WHEN user_id % 50 = 0 THEN [NULL] ELSE [event_type, 'K' || regexp_extract(props, '\\d+')] END) AS hint
FROM events WHERE event_type <> 'error'""")
def xml_explode_query(t: Tables):
    k = F.regexp_extract("props", r"(\d+)", 1)
    xml = F.concat(
        F.lit("<other_xml><info>x</info><outline_data><hint>"), F.col("event_type"), F.lit("</hint><hint><![CDATA[K"), k,
        F.lit("]]></hint></outline_data></other_xml>"),
    )
    xml = F.when(F.col("user_id") % 50 == 0, F.substring(xml, 1, 40)).otherwise(xml)  # texts that were cut off
    rows = t.events.select("event_id", F.when(F.col("event_type") != "error", xml).alias("xml"))
    return text.xml_explode(rows, "xml", "/other_xml/outline_data/hint/text()", "hint")


@query("xml_rows", """
WITH good AS (SELECT * FROM orders WHERE o_orderkey % 40 <> 0)
SELECT o_orderkey, false AS rejected, o_orderstatus AS partition_name, 1 AS partition_position, o_totalprice AS high_value FROM good WHERE o_totalprice < 100000
UNION ALL SELECT o_orderkey, false, 'C' || o_custkey, 2, o_custkey::DOUBLE FROM good WHERE o_custkey < 100000
UNION ALL SELECT o_orderkey, true, NULL, NULL, NULL FROM orders WHERE o_orderkey % 40 = 0""")
def xml_rows_query(t: Tables):
    def record(name, position, value):
        return [F.lit("<ROW><PARTITION_NAME>"), name, F.lit(f"</PARTITION_NAME><PARTITION_POSITION>{position}</PARTITION_POSITION><HIGH_VALUE>"),
                value.cast("string"), F.lit("</HIGH_VALUE></ROW>")]

    cust = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    xml = F.concat(
        F.lit("<ROWSET>"), *record(F.col("o_orderstatus"), 1, F.col("o_totalprice")), *record(cust, 2, F.col("o_custkey").cast("double")), F.lit("</ROWSET>")
    )
    xml = F.when(F.col("o_orderkey") % 40 == 0, F.substring(xml, 1, 30)).otherwise(xml)  # texts that were cut off
    schema = T.StructType([
        T.StructField("PARTITION_NAME", T.StringType()), T.StructField("PARTITION_POSITION", T.IntegerType()),
        T.StructField("HIGH_VALUE", T.DoubleType()),
    ])
    return text.xml_rows(t.orders.select("o_orderkey", xml.alias("xml")), "xml", "ROW", schema, below=("HIGH_VALUE", 100_000)).select(
        "o_orderkey", "rejected", *[F.col(f.name).alias(f.name.lower()) for f in schema]
    )


@query("string_agg_affix", """
SELECT p_brand, 'names: ' || string_agg(CASE WHEN p_size > 40 THEN '' ELSE p_name END, ', ' ORDER BY p_partkey) || '.' AS names
FROM part GROUP BY p_brand""")
def string_agg_affix_query(t: Tables):
    rows = t.part.select("p_brand", "p_partkey", F.when(F.col("p_size") <= 40, F.col("p_name")).alias("name"))
    return text.string_agg_affix(rows, ["p_brand"], ["p_partkey"], "name", "names", ", ", "names: ", ".")


@query("match_text_or_tag", """
WITH w AS (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT doc_id, source, text IN (SELECT text FROM w) AS matched_text FROM documents
WHERE text IN (SELECT text FROM w) OR source LIKE '%src7%' OR source LIKE '%src12%'""")
def match_text_or_tag_query(t: Tables):
    toxic = t.documents.join(t.labels.where(F.col("toxic") == 1), "doc_id", "left_semi").select("text")
    return text.match_text_or_tag(t.documents, toxic, ["src7", "src12"], "text", "source").select("doc_id", "source", "matched_text")


@query("contains_join", """
WITH p AS (
  SELECT item_id, array_to_string(string_split(text, ' ')[1:5], ' ') AS phrase FROM benchmark
  UNION ALL SELECT 1000000 + doc_id, substr(text, 1, 20) FROM documents WHERE doc_id % 50 = 0 AND length(text) >= 20
)
SELECT doc_id, item_id AS pattern_id FROM documents, p WHERE phrase <> '' AND contains(text, phrase)""")
def contains_join_query(t: Tables):
    """Documents that hold the first five words of a test item, or the beginning of a document of the list."""
    words = F.array_join(F.slice(F.split("text", " "), 1, 5), " ")
    openings = t.documents.where((F.col("doc_id") % 50 == 0) & (F.length("text") >= 20))
    phrases = t.benchmark.select(F.col("item_id").alias("pattern_id"), words.alias("phrase")).unionByName(
        openings.select((1_000_000 + F.col("doc_id")).alias("pattern_id"), F.substring("text", 1, 20).alias("phrase")))
    return contains_join(t.documents, phrases, "doc_id", "text", "pattern_id", "phrase")

"""Queries of the text and number expressions and of outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.catalog import Tables, query
from waymark.functions import numbers, text
from waymark.operators import routing

WORDS = routing.Vocabulary(skipped=["closed"], promoted=["URGENT"], labels={"2-HIGH": "Held"}, display_order=["Pass", "Fail"])
#: A street for each order line, and a number in one of many spellings.
STREETS = ["Kauri rd", "Rimu  Cresent", "Totara St.", "Tāwa Hts", "Kauri Road, Eastfield", "12 Rata Ave", "Mānuka Tce", "Lane", "Puriri Drive - West Bay", "Kōwhai"]
SUBURBS = ["Eastfield", "West Bay", "Ōrere"]


def _lines(t: Tables) -> DataFrame:
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    a, b = (k % 97 + 1).cast("string"), (F.col("l_partkey") % 40 + 1).cast("string")
    letter = F.get(F.array(*[F.lit(x) for x in "ABCDEFG"]), (n % 7).cast("int"))
    spelled = F.get(
        F.array(a, F.concat(a, letter), F.concat(a, F.lit("-"), b), F.concat(F.lit("Unit"), letter, F.lit("/"), a), F.concat(a, F.lit(" / unit "), b), F.concat(F.lit("unit 3 / "), a), F.concat(b, F.lit("-Nov")), F.concat(F.lit("Nov-"), a), F.concat(b, F.lit("/"), a), F.lit(""), F.concat(F.lit(". Unit15/"), b), F.concat(a, F.lit("~"), b), F.lit("dec"), F.concat(letter, a), F.concat(a, F.lit(" bis")), F.concat(F.lit("flat"), a, F.lit("/"), b), F.concat(b, F.lit("/ feb_"), a)),
        ((k + n) % 17).cast("int"),
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", spelled.alias("number"), letter.alias("letter"), F.get(F.array(*map(F.lit, STREETS)), (F.col("l_partkey") % 10).cast("int")).alias("street"))


_NUMBER_SQL = r"""
WITH l AS (
  SELECT l_orderkey, l_linenumber, CAST(l_orderkey % 97 + 1 AS VARCHAR) AS a, CAST(l_partkey % 40 + 1 AS VARCHAR) AS b,
         ['A','B','C','D','E','F','G'][l_linenumber % 7 + 1] AS letter, l_partkey FROM lineitem),
n AS (
  SELECT l_orderkey, l_linenumber, letter,
         [a, a || letter, a || '-' || b, 'Unit' || letter || '/' || a, a || ' / unit ' || b, 'unit 3 / ' || a, b || '-Nov', 'Nov-' || a,
          b || '/' || a, '', '. Unit15/' || b, a || '~' || b, 'dec', letter || a, a || ' bis', 'flat' || a || '/' || b, b || '/ feb_' || a][(l_orderkey + l_linenumber) % 17 + 1] AS number,
         ['Kauri rd', 'Rimu  Cresent', 'Totara St.', 'Tāwa Hts', 'Kauri Road, Eastfield', '12 Rata Ave', 'Mānuka Tce', 'Lane',
          'Puriri Drive - West Bay', 'Kōwhai'][l_partkey % 10 + 1] AS street
  FROM l),
u AS (
  SELECT *, trim(number) AS t,
         regexp_matches(trim(number), '(?i)^unit\s*([A-Za-z0-9]+)\s*/\s*(\d+[A-Za-z]?)$') AS uf,
         regexp_matches(trim(number), '(?i)^(\d+[A-Za-z]?)\s*/\s*unit\s*([A-Za-z0-9]+)$') AS hf
  FROM n),
s AS (
  SELECT *,
    CASE WHEN uf THEN 'Unit' || regexp_extract(t, '(?i)^unit\s*([A-Za-z0-9]+)\s*/', 1)
         WHEN hf THEN 'Unit' || regexp_extract(t, '(?i)unit\s*([A-Za-z0-9]+)$', 1) ELSE '' END AS unit,
    CASE WHEN uf THEN regexp_extract(t, '/\s*(\d+[A-Za-z]?)$', 1) WHEN hf THEN regexp_extract(t, '^(\d+[A-Za-z]?)', 1) ELSE '' END AS house
  FROM u)
"""


@query(
    _NUMBER_SQL
    + r"""
SELECT l_orderkey, l_linenumber, number, unit, house,
       CASE WHEN uf THEN house || '/' || 'Unit' || upper(substr(unit, 5)) ELSE number END AS house_first,
       CASE WHEN hf THEN 'Unit' || upper(substr(unit, 5)) || '/' || house ELSE number END AS unit_first,
       regexp_extract(CASE WHEN house <> '' THEN house ELSE t END, '(\d+)', 1) AS digits
FROM s
"""
)
def unit_split_and_flip(t: Tables) -> DataFrame:
    """I1-I4."""
    d = _lines(t).withColumn("s", numbers.split_unit("number"))
    return d.select("l_orderkey", "l_linenumber", "number", "s.unit", "s.house", numbers.house_first("number").alias("house_first"), numbers.unit_first("number").alias("unit_first"), numbers.house_digits("number").alias("digits"))


@query(
    _NUMBER_SQL
    + r"""
, z AS (SELECT *, regexp_replace(number, '\s+', '', 'g') AS bare FROM s),
y AS (
  SELECT *, regexp_replace(bare, '[^A-Za-z]', '', 'g') AS word, regexp_extract_all(bare, '\d+') AS nums, regexp_replace(regexp_replace(bare, '\d+', '9', 'g'), '[A-Za-z]+', 'x', 'g') AS shape,
         translate(bare, '~_-,.\:;!=+"''()', '///////////////') AS cut FROM z),
x AS (
  SELECT *, CAST(coalesce(nullif(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(word)), 0), 1) AS VARCHAR) AS month, lower(cut[1:4]) = 'unit' AS named,
         len(word) = 3 AND regexp_matches(shape, '^9?[-_/]*x([-_/]*9)?$') AS dated FROM y)
SELECT l_orderkey, l_linenumber,
       CASE WHEN dated THEN 'Unit' || CASE WHEN shape LIKE '9%' THEN nums[1] || '/' || month WHEN len(nums) > 0 THEN month || '/' || nums[1] ELSE month END
            WHEN shape = '9x' AND len(word) = 1 THEN 'Unit' || upper(word) || '/' || nums[1]
            WHEN named OR contains(cut, '/') THEN 'Unit' || upper(CASE WHEN named THEN cut[5:] ELSE cut END) ELSE upper(cut) END AS normal,
       regexp_matches(trim(number), '^(Unit[A-Za-z0-9]+/\d+(-\d+)?|\d+[A-Za-z]?(-\d+[A-Za-z]?)?)$') AS valid,
       CASE WHEN letter <> '' AND trim(number) <> '' THEN 'Unit' || letter || '/' || trim(number) WHEN trim(number) <> '' THEN trim(number) ELSE letter END AS merged
FROM x
"""
)
def normalise_number(t: Tables) -> DataFrame:
    """I5, I6, B19, M2."""
    return _lines(t).select("l_orderkey", "l_linenumber", numbers.normal_number("number").alias("normal"), numbers.is_number("number").alias("valid"), numbers.merge_unit("letter", "number").alias("merged"))


@query(
    _NUMBER_SQL
    + r"""
SELECT l_orderkey, l_linenumber,
       regexp_replace(lower(substr(unit, 5)), '[^a-z0-9]+', '', 'g') AS unit_key,
       regexp_replace(lower(CASE WHEN house <> '' THEN house ELSE t END), '[^a-z0-9]+', '', 'g') AS house_key,
       regexp_replace(strip_accents(regexp_replace(lower(trim(street)), '\b\d{4}\s*$', '')), '[^a-z0-9]+', '', 'g') AS street_key
FROM s
"""
)
def gate_key(t: Tables) -> DataFrame:
    """I8, C5's key, T1, T11."""
    d = _lines(t).withColumn("k", numbers.gate_key(F.lit(""), "number", "street"))
    return d.select("l_orderkey", "l_linenumber", F.col("k.unit").alias("unit_key"), F.col("k.house").alias("house_key"), F.col("k.street").alias("street_key"))


@query(
    _NUMBER_SQL
    + r"""
, q AS (SELECT DISTINCT street, trim(regexp_replace(street, '\s+', ' ', 'g')) AS s0 FROM s),
p AS (SELECT *, regexp_replace(lower(regexp_extract(s0, '([^ ]+)$', 1)), '\.$', '') AS last FROM q),
e AS (
  SELECT *, CASE WHEN contains(s0, ' ') AND last IN ('rd', 'cresent', 'st', 'hts', 'ave', 'tce')
            THEN regexp_replace(s0, '[^ ]+$', '') || map {'rd': 'Road', 'cresent': 'Crescent', 'st': 'Street', 'hts': 'Heights', 'ave': 'Avenue', 'tce': 'Terrace'}[last]
            ELSE s0 END AS expanded FROM p)
SELECT street, expanded,
       regexp_replace(expanded, '(?i)^(.*\b(?:Road|Drive))[\s,\-–]+(?:Eastfield|West Bay)$', '\1') AS stripped,
       strip_accents(street) AS folded, regexp_replace(s0, '^(?:\S*\d\S*\s+)+', '') AS unnumbered,
       CASE WHEN regexp_matches(expanded, ' (Road|Crescent|Street|Heights|Avenue|Terrace)$') THEN regexp_extract(expanded, '([^ ]+)$', 1) ELSE '' END AS suffix,
       regexp_matches(street, '[^A-Za-z0-9\s,''\-/āĀēĒīĪōŌūŪ]') AS odd
FROM e
"""
)
def street_names(t: Tables) -> DataFrame:
    """H2, H4, H5, H6, H17, B18."""
    s = F.col("street")
    e = text.expand_suffix(s)
    d = _lines(t).select("street").distinct()
    return d.select("street", e.alias("expanded"), text.strip_suburb_tail(e, SUBURBS).alias("stripped"), text.fold(s).alias("folded"), text.strip_leading_number(s).alias("unnumbered"), text.split_suffix(e)["suffix"].alias("suffix"), text.has_invalid_chars(s).alias("odd"))


@query(
    _NUMBER_SQL
    + r"""
, q AS (SELECT DISTINCT street, trim(regexp_replace(street, '\s+', ' ', 'g')) AS s0 FROM s)
SELECT street,
       CASE WHEN regexp_matches(lower(strip_accents(s0)), '[\s,\-–]+(west bay|eastfield|orere)$')
            THEN regexp_replace(regexp_replace(s0, '(?i)(West Bay|Eastfield|Ōrere)$', ''), '[\s,\-–]+$', '') ELSE s0 END AS lifted,
       CASE WHEN regexp_matches(lower(s0), 'west bay$') THEN 'West Bay' WHEN regexp_matches(lower(s0), 'eastfield$') THEN 'Eastfield' ELSE '' END AS suburb
FROM q
"""
)
def lift_suburb(t: Tables) -> DataFrame:
    """H7."""
    d = _lines(t).select("street").distinct().withColumn("l", text.lift_suburb("street", F.lit(""), SUBURBS))
    return d.select("street", F.col("l.street").alias("lifted"), F.col("l.suburb").alias("suburb"))


@query(
    r"""
WITH a AS (SELECT c_custkey, CAST(c_custkey % 200 AS VARCHAR) || ' ' || c_mktsegment || ' Road, ' || c_name || ', Auckland' AS line FROM customer)
SELECT c_custkey, regexp_extract(line, '^(\d+) ', 1) AS number, regexp_extract(line, '^\d+ ([^,]*),', 1) AS street,
       trim(split_part(line, ',', 2)) AS suburb, regexp_extract(line, '^([^,]*,[^,]*),', 1) AS again
FROM a
"""
)
def address_parts(t: Tables) -> DataFrame:
    """H10."""
    line = F.concat((F.col("c_custkey") % 200).cast("string"), F.lit(" "), "c_mktsegment", F.lit(" Road, "), "c_name", F.lit(", Auckland"))
    d = t.customer.select("c_custkey", text.address_parts(line).alias("p"))
    return d.select("c_custkey", "p.*", text.address_line(F.col("p.number"), F.col("p.street"), F.col("p.suburb")).alias("again"))


@query(
    r"""
SELECT doc_id, md5(regexp_replace(strip_accents(regexp_replace(lower(trim(text)), '\b\d{4}\s*$', '')), '[^a-z0-9]+', '', 'g')) AS key_md5,
       CAST(len(regexp_extract_all(lower(text), '[A-Za-z0-9'']+')) AS INTEGER) AS n_tokens, regexp_matches(text, '\d') AS has_digit
FROM documents
"""
)
def canon_text_documents(t: Tables) -> DataFrame:
    """H1, H2, H16."""
    return t.documents.select("doc_id", F.md5(text.canon_text("text")).alias("key_md5"), text.n_tokens("text").alias("n_tokens"), text.has_digit("text").alias("has_digit"))


@query(
    r"""
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name || ' 3rd o''neil'), '[a-z]+|[^a-z]+'), lambda x: upper(x[1]) || x[2:]), '') AS titled,
       regexp_replace(regexp_replace(p_type || '/' || p_brand, '[<>:"/\\|?*]', '_', 'g'), '^[. ]+|[. ]+$', '', 'g') AS stem
FROM part
"""
)
def title_py_part(t: Tables) -> DataFrame:
    """H3, H14."""
    return t.part.select("p_partkey", text.title(F.concat("p_name", F.lit(" 3rd o'neil"))).alias("titled"), text.file_stem(F.concat("p_type", F.lit("/"), "p_brand")).alias("stem"))


@query(
    r"""
WITH c AS (
  SELECT conv_id, turn, role, regexp_replace(text, '\([^)]*\)', ' ', 'g') || ' / ' || role || '|' || upper(role) || ' / see 3/4/2024 ' AS note FROM conversations),
p AS (
  SELECT conv_id, turn, role, list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(note, '\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b', ' ', 'g'), '\b\d{4}-\d{2}-\d{2}\b', ' ', 'g'), '[/|]'),
         lambda s: regexp_replace(trim(regexp_replace(s, '\s+', ' ', 'g')), '^[\s,;:.\-]+|[\s,;:\-]+$', '', 'g')), lambda s: s <> '') AS parts FROM c),
d AS (SELECT *, list_filter(parts, lambda x, i: list_position(list_transform(parts, lambda y: lower(y)), lower(x)) = i) AS kept FROM p)
SELECT conv_id, turn, CAST(len(kept) AS INTEGER) AS n, md5(array_to_string(list_transform(kept, lambda s: upper(s[1]) || s[2:]), ' / ')) AS note_md5
FROM d
"""
)
def notes_segments(t: Tables) -> DataFrame:
    """H11, H13, L6, M1."""
    note = F.concat(F.regexp_replace("text", r"\([^)]*\)", " "), F.lit(" / "), "role", F.lit("|"), F.upper("role"), F.lit(" / see 3/4/2024 "))
    return t.conversations.select("conv_id", "turn", F.size(text.note_segments(note)).alias("n"), F.md5(text.clean_note(note)).alias("note_md5"))


@query(
    """
SELECT event_id, CASE WHEN event_type = '' THEN '' ELSE event_type END
         || CASE WHEN lower(event_type) = lower(coalesce(json_extract_string(props, '$.page'), '')) OR coalesce(json_extract_string(props, '$.page'), '') = '' THEN '' ELSE ' | ' || trim(json_extract_string(props, '$.page')) END AS merged
FROM events
"""
)
def merge_notes(t: Tables) -> DataFrame:
    """H13."""
    return t.events.select("event_id", text.merge_notes(F.col("event_type"), F.get_json_object("props", "$.page"), F.upper("event_type")).alias("merged"))


@query(
    r"""
WITH v AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN '0' WHEN 1 THEN ' ' WHEN 2 THEN CAST(o_custkey AS VARCHAR) || '.0' WHEN 3 THEN 'nan' WHEN 4 THEN ' -3.5 ' ELSE '1_0' END AS v FROM orders)
SELECT o_orderkey, regexp_replace(v, '^(-?\d+)\.0$', '\1') AS text, trim(v) IN ('', '0') OR coalesce(TRY_CAST(regexp_replace(trim(v), '^(nan|1_0)$', 'x') AS DOUBLE) = 0, false) AS is_blank,
       CASE WHEN regexp_matches(trim(v), '^[+-]?(\d+\.?\d*|\.\d+)$') THEN CAST(trim(v) AS DOUBLE) END AS number
FROM v
"""
)
def safe_values(t: Tables) -> DataFrame:
    """B1, B2, B3."""
    k = F.col("o_orderkey") % 6
    v = F.when(k == 0, "0").when(k == 1, " ").when(k == 2, F.concat(F.col("o_custkey").cast("string"), F.lit(".0"))).when(k == 3, "nan").when(k == 4, " -3.5 ").otherwise("1_0")
    d = t.orders.select("o_orderkey", v.alias("v"))
    return d.select("o_orderkey", text.text("v").alias("text"), text.blank("v").alias("is_blank"), text.number("v").alias("number"))


_OUTCOME = "CASE o_orderstatus WHEN 'F' THEN ' Pass ' WHEN 'O' THEN 'Fail' ELSE 'OK' END"


def _outcomes(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.withColumn("outcome", F.when(s == "F", " Pass ").when(s == "O", "Fail").otherwise("OK"))


@query(f"SELECT o_orderkey, CASE WHEN lower(trim({_OUTCOME})) IN ('pass', 'ok') THEN 'clean' ELSE 'fail' END AS route FROM orders")
def route_partition(t: Tables) -> DataFrame:
    """B4, B5."""
    return routing.routed(_outcomes(t), "outcome").select("o_orderkey", "route")


@query(f"SELECT CASE WHEN lower(trim({_OUTCOME})) IN ('pass', 'ok') THEN 'clean' ELSE 'fail' END AS route, count(*) AS n FROM orders GROUP BY 1")
def route_counts(t: Tables) -> DataFrame:
    return routing.route_counts(routing.routed(_outcomes(t), "outcome"))


@query(
    f"""
WITH s AS (SELECT trim({_OUTCOME}) AS status FROM orders)
SELECT coalesce(status, 'Total') AS status, count(*) AS n,
       CAST(CASE WHEN grouping(status) = 1 THEN 3 WHEN status = 'Pass' THEN 0 WHEN status = 'Fail' THEN 1 ELSE 2 END AS INTEGER) AS position
FROM s GROUP BY ROLLUP (status)
"""
)
def status_summary(t: Tables) -> DataFrame:
    """D16."""
    return routing.status_summary(_outcomes(t), "outcome", WORDS)


@query(
    """
WITH s AS (SELECT o_orderkey, o_orderpriority AS priority, CASE o_orderkey % 3 WHEN 0 THEN 'Fail' WHEN 1 THEN 'duplicate' ELSE 'Pass' END AS outcome FROM orders)
SELECT o_orderkey, CASE WHEN lower(priority) = '1-urgent' AND outcome <> 'duplicate' THEN 'Pass' ELSE outcome END AS outcome,
       lower(outcome) = 'fail' AND lower(priority) <> '5-low' AS retry FROM s
"""
)
def reclassify_and_retry(t: Tables) -> DataFrame:
    """B6, B7."""
    words = routing.Vocabulary(skipped=["5-LOW"], promoted=["1-URGENT"])
    k = F.col("o_orderkey") % 3
    d = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.when(k == 0, "Fail").when(k == 1, "duplicate").otherwise("Pass").alias("outcome"))
    d = d.withColumn("retry", routing.is_retryable("outcome", "priority", words))
    return routing.reclassified(d, "outcome", "priority", words).select("o_orderkey", "outcome", "retry")


@query(
    """
SELECT o_orderkey,
       CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Pass' WHEN o_orderkey % 7 = 0 THEN 'Fail' WHEN o_custkey % 5 = 0 THEN 'Fail'
            WHEN o_orderkey % 4 = 0 AND o_orderstatus <> 'P' THEN 'Fail' WHEN o_orderpriority = '2-HIGH' THEN 'Held' ELSE 'Pass' END AS final_status
FROM orders
"""
)
def classify_rows(t: Tables) -> DataFrame:
    """B8."""
    d = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "other").when(F.col("o_orderstatus") == "P", "Business").otherwise("House").alias("Type"),
        F.when(F.col("o_orderkey") % 7 == 0, "").otherwise("12").alias("Number"),
        F.when(F.col("o_custkey") % 5 == 0, "Kauri").otherwise("Kauri Road").alias("Street"),
        F.lit(" ").alias("Suburb"),
        F.col("o_orderpriority").alias("Status"),
    )
    done = routing.classified(d, WORDS, F.col("o_orderkey") % 4 != 0)
    return done.select("o_orderkey", F.col("Final Status").alias("final_status"))


@query(
    """
SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 400 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'language' END, CASE WHEN source = 'src0' THEN 'source' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM documents
"""
)
def fail_reasons(t: Tables) -> DataFrame:
    """B9."""
    found = routing.reasons([(F.col("n_chars") < 400, "short"), (F.col("lang") != "en", "language"), (F.col("source") == "src0", "source")])
    return t.documents.select("doc_id", F.array_join(found, ",").alias("reasons"))


@query(
    r"""
WITH n AS (SELECT o_orderkey, o_orderstatus AS status, CASE WHEN o_orderkey % 9 = 0 THEN 'a New  Streets here' WHEN o_orderkey % 9 = 1 THEN 'newstreet' ELSE 'renew street' END AS notes FROM orders)
SELECT o_orderkey, regexp_matches(notes, '(?i)\bnew\s*streets?\b') AS is_new,
       CASE WHEN regexp_matches(notes, '(?i)\bnew\s*streets?\b') THEN notes || ' / checked' ELSE notes END AS notes,
       CASE WHEN regexp_matches(notes, '(?i)\bnew\s*streets?\b') THEN 'Custom3' WHEN status = 'F' THEN 'Finished' ELSE status END AS status
FROM n
"""
)
def new_street_override(t: Tables) -> DataFrame:
    """B10, B11, B12."""
    k = F.col("o_orderkey") % 9
    d = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("Status"), F.lit("1").alias("Number"), F.when(k == 0, "a New  Streets here").when(k == 1, "newstreet").otherwise("renew street").alias("Notes"))
    d = routing.new_street_override(routing.renamed_status(d.withColumn("is_new", routing.says_new_street("Notes")), {"f": "Finished"}), "checked")
    return d.select("o_orderkey", "is_new", F.col("Notes").alias("notes"), F.col("Status").alias("status"))


@query(
    """
SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'PATCHED' WHEN c_nationkey = 5 AND c_mktsegment = 'BUILDING' THEN 'BUILDING' WHEN c_nationkey = 5 THEN 'X' ELSE c_mktsegment END AS segment
FROM customer
"""
)
def overrides_and_protection(t: Tables) -> DataFrame:
    """B13, B14."""
    table = t.spark.createDataFrame([(3, "PATCHED"), (5, "X")], "c_nationkey int, c_mktsegment string")
    d = routing.overridden(t.customer.withColumn("_was", F.col("c_mktsegment")), table, ["c_nationkey"])
    keep = F.when(F.col("c_nationkey") == 5, routing.protected("c_mktsegment", "_was", ["building"])).otherwise(F.col("c_mktsegment"))
    return d.select("c_custkey", keep.alias("segment"))


@query(
    """
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, CASE WHEN s_nationkey % 2 = 0 THEN s_name ELSE CAST(s_nationkey AS VARCHAR) END AS "PostalCode",
       CASE WHEN s_nationkey % 2 = 0 THEN s_name ELSE CAST(s_nationkey AS VARCHAR) END AS "Postcode", 'House' AS "Type" FROM supplier
"""
)
def mirror_and_default(t: Tables) -> DataFrame:
    """B15, B16, B21."""
    d = t.supplier.select("s_suppkey", F.when(F.col("s_nationkey") % 2 == 0, F.col("s_name")).otherwise("").alias("PostalCode"), F.col("s_nationkey").cast("string").alias("Postcode"), F.lit(" ").alias("Type"), F.lit(1).alias("_technical"))
    return routing.public_columns(routing.defaulted(routing.mirrored(d, "PostalCode", "Postcode"), {"Type": "House"}))


@query(
    """
SELECT c_custkey, array_to_string(list_filter(['number', CASE WHEN c_nationkey % 2 = 0 THEN 'suburb' END], lambda x: x IS NOT NULL), ',') AS empty_fields
FROM customer WHERE c_mktsegment = 'BUILDING'
"""
)
def blank_audit(t: Tables) -> DataFrame:
    """B20."""
    b = F.col("c_mktsegment") == "BUILDING"
    d = t.customer.select((F.col("c_custkey") + 1).alias("id"), F.when(b, " ").otherwise("7").alias("number"), F.when(F.col("c_nationkey") % 2 == 0, "").otherwise("unset").alias("suburb"))
    found = routing.blank_audit(d, ["number", "suburb"], "unset")
    return found.select((F.col("id") - 1).alias("c_custkey"), F.array_join("empty_fields", ",").alias("empty_fields"))


@query(
    r"""
SELECT o_orderkey, o_orderkey % 5 <> 0 AND o_orderstatus <> 'P' AND NOT (o_orderkey % 3 = 0 AND o_custkey % 2 = 0) AS ok,
       CASE WHEN o_orderkey % 5 = 0 THEN 'Number and Street are required' WHEN o_orderstatus = 'P' THEN 'Type is not known'
            WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 'Map is required for a change' ELSE '' END AS message,
       CASE WHEN o_orderkey % 3 = 0 THEN 'updates' ELSE 'new' END AS destination
FROM orders
"""
)
def submission_check(t: Tables) -> DataFrame:
    """B22."""
    d = t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("4").alias("Number"),
        F.lit("Kauri Road").alias("Street"),
        F.col("o_orderstatus").alias("Type"),
        F.when(F.col("o_orderkey") % 3 == 0, "please Update this").otherwise("updating").alias("Notes"),
        F.when(F.col("o_custkey") % 2 == 0, "").otherwise("1.2").alias("Map"),
    )
    return d.select("o_orderkey", routing.submission_check(["F", "O"]).alias("c")).select("o_orderkey", "c.*")


@query(
    r"""
SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN regexp_matches(props, '\d') THEN ['digit'] ELSE [] END,
  list_transform(regexp_extract_all(props, '[^A-Za-z0-9_\s''\-]'), lambda s: 'symbol:' || s)))), ' ') AS labels
FROM events
"""
)
def issue_labels(t: Tables) -> DataFrame:
    """H18."""
    return t.events.select("event_id", F.array_join(text.issues("props"), " ").alias("labels"))


@query(
    """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Mount Eden' WHEN 1 THEN 'Eastfield' WHEN 2 THEN 'West Bay' ELSE 'Ōrere' END AS suburb,
       c_custkey % 4 = 3 AS is_code, CASE WHEN c_custkey % 4 = 3 THEN 'Long Road' ELSE 'Rd 2 Road' END AS street
FROM customer
"""
)
def canon_suburbs(t: Tables) -> DataFrame:
    """H8, H9."""
    k = F.col("c_custkey") % 4
    raw = F.when(k == 0, "mt eden 1024").when(k == 1, "Eastfield, Auckland").when(k == 2, "west  bay").otherwise("orere")
    code = F.when(k == 3, "R.D. 2").otherwise("Rd 2 Road")
    names = text.canon_suburb(raw, {"mt eden": "Mount Eden", "orere": "Ōrere"}, ["auckland"])
    return t.customer.select("c_custkey", names.alias("suburb"), text.is_delivery_code(code).alias("is_code"), F.when(k == 3, text.strip_delivery_code(F.lit("RD 2, Long Road"))).otherwise(code).alias("street"))

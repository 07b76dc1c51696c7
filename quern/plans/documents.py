"""Queries of JSON documents and the inverted index."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import docindex as di
from quern.operators import jsondoc as j
from quern.operators import jsonedit as je
from quern.plans import bind as b
from quern.plans.registry import add
from quern.sources.tables import load

def doc():
    return F.col("doc")


def _props(s, d):
    return load(s, d, "events").select(F.col("event_id").alias("key"), F.col("props").alias("doc"))


def _mixed(s, d):
    """Objects with a member of every kind, and some that are no JSON."""
    return load(s, d, "events").select(F.col("event_id").alias("key"), F.concat(
        F.lit('{"n":'), F.col("user_id").cast("string"), F.lit(',"s":"'), F.col("event_type"), F.lit('","b":'), F.when(F.col("event_id") % 2 == 0, "true").otherwise("false"), F.lit(',"z":null,"a":[1,2,'), F.col("user_id").cast("string"), F.lit('],"o":{"x":1}}')).alias("doc"))


def _profiles(s, d):
    """A document for each user: name, event numbers as tags, an inner object; some without tags, some with a text there."""
    e = load(s, d, "events").groupBy(F.col("user_id").alias("key")).agg(
        F.sort_array(F.collect_list("event_id")).alias("ids"), F.concat_ws("", F.sort_array(F.collect_set("event_type"))).alias("types"), F.count("*").alias("n"),
    )
    tags = F.when(F.col("key") % 5 == 0, "").when(F.col("key") % 7 == 0, '"tags":"none",').otherwise(F.concat(F.lit('"tags":['), F.array_join("ids", ","), F.lit("],")))
    on = F.when(F.col("n") % 2 == 0, "true").otherwise("false")
    inner = F.concat(F.lit('"o":{"n":'), F.col("n").cast("string"), F.lit(',"on":'), on, F.lit(',"kinds":"'), F.col("types"), F.lit('"}'))
    return e.select("key", F.concat(F.lit('{"name":"user'), F.col("key").cast("string"), F.lit('",'), tags, inner, F.lit(',"a b":[{"x":null}]}')).alias("doc"))


#: The same documents by their parts: ``tags`` is null where there is no array.
PROFILE = """(SELECT *, CASE WHEN key % 5 = 0 OR key % 7 = 0 THEN NULL ELSE ids END AS tags, n % 2 = 0 AS flag FROM
  (SELECT user_id AS key, list(event_id ORDER BY event_id) AS ids, array_to_string(list_sort(list(DISTINCT event_type)), '') AS kinds, count(*) AS n FROM events GROUP BY 1))"""
REST = """CASE WHEN key % 5 = 0 THEN '' WHEN key % 7 = 0 THEN '"tags":"none",' ELSE '"tags":[' || array_to_string({tags}, ',') || '],' END"""
TEXT = """'{"name":"user' || key || '",' || {rest} || '"o":{"n":' || {n} || ',"on":' || {on} || ',"kinds":"' || {kinds} || '"},"a b":[{"x":null}]}'"""
ERROR = "CASE WHEN key % 5 = 0 THEN 'path does not exist' WHEN key % 7 = 0 THEN 'path is not an array' END"


def _text(tags="tags", n="n", on="flag", kinds="kinds"):
    parts = {"rest": REST.replace("{tags}", tags), "n": n, "on": on, "kinds": kinds}
    out = TEXT
    for k, v in parts.items():
        out = out.replace("{" + k + "}", v)
    return out


def _edited(name, change, doc_sql, reply, error="NULL"):
    """A query of the changed documents with replies and errors, beside the SQL that puts them together anew."""
    query = lambda s, d: _profiles(s, d).select("key", change(doc()).alias("x")).select("key", "x.*")
    add(name, query, f"SELECT key, {doc_sql} AS doc, ({reply})::VARCHAR AS reply, ({error})::VARCHAR AS error FROM {PROFILE} AS p")


E = "events"
add(
    "json_get",
    lambda s, d: _props(s, d).select("key", j.get(doc(), "$.k").alias("value")),
    "SELECT event_id AS key, (props::JSON -> '$.k')::VARCHAR AS value FROM events",
)
add(
    "json_get_string",
    lambda s, d: _mixed(s, d).select("key", j.get(doc(), "$.s").alias("value")),
    """SELECT event_id AS key, '"' || event_type || '"' AS value FROM events""",
)
add(
    "json_mget",
    lambda s, d: j.mget(_props(s, d), load(s, d, "customer").select(F.col("c_custkey").alias("pos"), (F.col("c_custkey") * 5).alias("key")), "$.k"),
    "SELECT c_custkey AS pos, c_custkey * 5 AS key, (props::JSON -> '$.k')::VARCHAR AS value FROM customer LEFT JOIN events ON event_id = c_custkey * 5",
)
add(
    "json_type",
    lambda s, d: _profiles(s, d).select("key", *(j.type_of(doc(), p).alias(n) for n, p in (("t_name", "$.name"), ("t_tags", "$.tags"), ("t_tag", "$.tags[1]"), ("t_o", "$.o"), ("t_on", "$.o.on"), ("t_x", "$['a b'][0].x")))),
    f"""
SELECT key, 'string' AS t_name, CASE WHEN key % 5 = 0 THEN NULL WHEN key % 7 = 0 THEN 'string' ELSE 'array' END AS t_tags, CASE WHEN len(tags) > 1 THEN 'number' END AS t_tag, 'object' AS t_o, 'boolean' AS t_on, 'null' AS t_x FROM {PROFILE} AS p""",
)
add(
    "json_objkeys",
    lambda s, d: _profiles(s, d).select("key", F.array_join(je.objkeys(doc()), ",").alias("names"), F.array_join(je.objkeys(doc(), "$.o"), ",").alias("inner"), je.objkeys(doc(), "$.name").isNull().alias("none")),
    f"""
SELECT key, 'name,' || CASE WHEN key % 5 = 0 THEN '' ELSE 'tags,' END || 'o,a b' AS names, 'n,on,kinds' AS inner, true AS none FROM {PROFILE} AS p""".replace("AS inner", 'AS "inner"'),
)
add(
    "json_objlen",
    lambda s, d: _profiles(s, d).select("key", je.objlen(doc()).alias("n"), je.objlen(doc(), "$['a b'][0]").alias("one"), je.objlen(doc(), "$.tags").alias("none")),
    f"""
SELECT key, CASE WHEN key % 5 = 0 THEN 3 ELSE 4 END::BIGINT AS n, 1::BIGINT AS one, NULL::BIGINT AS none FROM {PROFILE} AS p""",
)
add(
    "json_arrlen",
    lambda s, d: _profiles(s, d).select("key", j.arrlen(doc(), "$.tags").alias("n"), j.arrlen(doc(), "$.o").alias("none")),
    f"SELECT key, len(tags)::BIGINT AS n, NULL::BIGINT AS none FROM {PROFILE} AS p",
)
add(
    "json_strlen",
    lambda s, d: _profiles(s, d).select("key", j.strlen(doc(), "$.o.kinds").alias("n")),
    f"SELECT key, length(kinds)::BIGINT AS n FROM {PROFILE} AS p",
)
_edited("json_arrappend", lambda x: je.arrappend(x, "$.tags", F.lit("-1"), F.lit("-2")), _text("list_concat(tags, [-1, -2])"), "len(tags) + 2", ERROR)
_edited(
    "json_arrinsert",
    lambda x: je.arrinsert(x, "$.tags", -3, F.lit("-1")),
    _text("list_concat(list_concat(tags[:greatest(len(tags) - 2, 0)], [-1]), tags[greatest(len(tags) - 2, 0) + 1:])"),
    "len(tags) + 1",
    ERROR,
)
_edited(
    "json_arrpop",
    lambda x: je.arrpop(x, "$.tags", 1),
    _text("CASE WHEN len(tags) > 1 THEN list_concat(tags[:1], tags[3:]) ELSE tags END"),
    "tags[2]",
)
_edited(
    "json_arrtrim",
    lambda x: je.arrtrim(x, "$.tags", 1, -2),
    _text("tags[2:len(tags) - 1]"),
    "CASE WHEN tags IS NOT NULL THEN greatest(len(tags) - 2, 0) END",
    ERROR,
)
add(
    "json_arrindex",
    lambda s, d: _profiles(s, d).select("key", je.arrindex(doc(), "$.tags", je.value_at(doc(), "$.tags[3]")).alias("found"), je.arrindex(doc(), "$.tags", F.lit("-9")).alias("none"), je.arrindex(doc(), "$.tags", je.value_at(doc(), "$.tags[0]"), 1).alias("after")),
    f"""
SELECT key, CASE WHEN len(tags) >= 4 THEN 3 ELSE -1 END::BIGINT AS found, -1::BIGINT AS none, -1::BIGINT AS after FROM {PROFILE} AS p""",
)
_edited("json_strappend", lambda x: je.strappend(x, "$.o.kinds", F.lit("+é")), _text(kinds="kinds || '+é'"), "length(kinds) + 2")
_edited("json_numincrby", lambda x: je.numincrby(x, "$.o.n", 2.5), _text(n="(n + 2) || '.5'"), "(n + 2) || '.5'")
_edited("json_nummultby", lambda x: je.nummultby(x, "$.o.n", 3.0), _text(n="n * 3"), "n * 3")
_edited("json_toggle", lambda x: je.toggle(x, "$.o.on"), _text(on="(NOT flag)"), "CASE WHEN flag THEN 0 ELSE 1 END")
_edited("json_toggle_refused", lambda x: je.toggle(x, "$.name"), _text(), "NULL", "'path is not a boolean'")
_edited("json_clear", lambda x: je.clear(x, "$.tags"), _text("[]"), "CASE WHEN tags IS NOT NULL THEN 1 ELSE 0 END")
_edited("json_del", lambda x: je.delete(x, "$.o.on"), _text().replace(""","on":' || flag || '""", ""), "1")
_edited("json_del_element", lambda x: je.delete(x, "$.tags[0]"), _text("tags[2:]"), "CASE WHEN len(tags) > 0 THEN 1 ELSE 0 END")
add(
    "json_set",
    lambda s, d: _profiles(s, d).select("key", je.set_value(doc(), "$.o.n", F.lit('{"y":[1.0,"2"]}')).alias("doc")),
    f"""SELECT key, {_text(n="'{" + '"y":[1,"2"]' + "}'")} AS doc FROM {PROFILE} AS p""",
)
add(
    "json_set_member",
    lambda s, d: _props(s, d).select("key", j.with_member(doc(), "a", F.lit("[1]")).alias("doc")),
    """SELECT event_id AS key, '{"a":[1],"k":' || (props::JSON ->> '$.k') || '}' AS doc FROM events""",
)
add(
    "json_del_member",
    lambda s, d: _mixed(s, d).select("key", j.get(j.without_member(doc(), "o"), "$.o").alias("gone"), j.get(j.without_member(doc(), "o"), "$.n").alias("n")),
    "SELECT event_id AS key, NULL::VARCHAR AS gone, user_id::VARCHAR AS n FROM events",
)
add(
    "json_wildcard",
    lambda s, d: load(s, d, "events").select(F.col("event_id").alias("key"), j.get(F.concat(F.lit('{"a":[{"b":'), F.col("user_id").cast("string"), F.lit('},{"c":1}]}')), "$.a[*].b").alias("value")),
    "SELECT event_id AS key, '[' || user_id || ',null]' AS value FROM events",
)
add(
    "json_descend",
    lambda s, d: load(s, d, "events").select(F.col("event_id").alias("key"), j.descend(F.concat(F.lit('{"a":[{"b":'), F.col("user_id").cast("string"), F.lit('},{"c":{"b":2}}]}')), "$..b").alias("value")),
    "SELECT event_id AS key, '[' || user_id || ',2]' AS value FROM events",
)
add(
    "json_set_deep",
    lambda s, d: j.update_path(_profiles(s, d), "$.o.y[1]", F.lit("7")),
    f"""SELECT key, replace({_text()}, '"}},"a b"', '","y":[null,7]}},"a b"') AS doc FROM {PROFILE} AS p""",
)

TOK = "(SELECT DISTINCT doc_id AS doc, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: t <> '')) AS term FROM documents)"


def _docs(s, d):
    return load(s, d, "documents").select(F.col("doc_id").alias("doc"), "text", "n_chars", "lang", "source")


def _index(s, d):
    return di.postings(_docs(s, d), ["text"])


FOUND = f"SELECT doc FROM {TOK} AS t GROUP BY doc HAVING bool_or(contains(term, 'ther')) AND bool_or(contains(term, 'ing'))"
add("doc_postings", lambda s, d: di.frequencies(_index(s, d)), f"SELECT term, count(*) AS n_docs FROM {TOK} AS t GROUP BY term")
add("doc_search", lambda s, d: di.search(_index(s, d), "Ther, ing"), FOUND)
add(
    "doc_search_filter",
    lambda s, d: di.search(_index(s, d), "ther ing", di.numeric(_docs(s, d), ["n_chars"]), "n_chars", 500, 2000),
    f"{FOUND} AND doc IN (SELECT doc_id FROM documents WHERE n_chars BETWEEN 500 AND 2000)",
)
add(
    "doc_search_limit",
    lambda s, d: di.search(_index(s, d), "ther", offset=5, count=10),
    f"SELECT DISTINCT doc FROM {TOK} AS t WHERE contains(term, 'ther') ORDER BY doc LIMIT 10 OFFSET 5",
)
add(
    "doc_index_update",
    lambda s, d: di.frequencies(di.update(_index(s, d), _docs(s, d).where("doc % 4 = 0").withColumn("text", F.concat(F.lit("updated "), F.col("lang"))), ["text"])),
    f"""
SELECT term, count(*) AS n_docs FROM (SELECT doc, term FROM {TOK} AS t WHERE doc % 4 <> 0 UNION ALL SELECT doc_id, unnest(['updated', lang]) FROM documents WHERE doc_id % 4 = 0) GROUP BY term""",
)
add(
    "doc_index_del",
    lambda s, d: di.remove(_index(s, d), _docs(s, d).where("doc % 2 = 0")).groupBy("doc").agg(F.count("*").alias("n_terms")),
    f"SELECT doc, count(*) AS n_terms FROM {TOK} AS t WHERE doc % 2 = 1 GROUP BY doc",
)
add(
    "doc_aggregate_count",
    lambda s, d: di.aggregate(_docs(s, d).withColumn("lang", F.when(F.col("lang") != "es", F.col("lang"))), "lang"),
    "SELECT CASE WHEN lang = 'es' THEN 'undefined' ELSE lang END AS grp, count(*) AS value FROM documents GROUP BY 1",
)
add(
    "doc_aggregate_sum",
    lambda s, d: di.aggregate(_docs(s, d), "source", "SUM", "n_chars"),
    "SELECT source AS grp, sum(n_chars)::DOUBLE AS value FROM documents GROUP BY 1",
)

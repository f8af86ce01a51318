"""Queries for scoring, searching, ranking and paging of names and bodies."""

from pyspark.sql import functions as F

from lodeline.functions import scoring as S
from lodeline.operators import ordered as O
from lodeline.operators import postings as P
from lodeline.operators import search as Q
from lodeline.plans import views as V
from lodeline.plans.registered import query
from lodeline.session import stored

# one query per tier: exact, prefix, initials, word, tokens, substring, subsequence, none
TIER_QUERIES = ["SmallRing", "small", "SR", "ring", "ring all", "allri", "srg", "zzz"]


def fold(text: str) -> str:
    return text.lower()


def subsequence_sql(name: str, text: str) -> str:
    """Greedy positions one after the other, as SQL; long queries by one pattern."""
    chars = list(fold(text))
    if len(chars) > 4:
        pattern = f"^[^{chars[0]}]*({chars[0]}" + "".join(f"[^{c}]*{c}" for c in chars[1:]) + ")"
        span = f"length(regexp_extract(lower({name}), '{pattern}', 1))"
        gap = f"(({span} - {len(chars)}) / {float(len(chars) - 1)})"
        return f"(CASE WHEN {span} > 0 THEN greatest(1.0, 50.0 - floor({gap} * 5)) ELSE 0.0 END)"
    first = place = f"instr(lower({name}), '{chars[0]}')"
    for c in chars[1:]:
        rest = f"instr(substr(lower({name}), {place} + 1), '{c}')"
        place = f"(CASE WHEN {place} > 0 AND {rest} > 0 THEN {place} + {rest} ELSE 0 END)"
    m = len(chars)
    gap = f"(({place} - {first} - {m - 1}) / {float(max(m - 1, 1))})"
    score = "50.0" if m == 1 else f"greatest(1.0, 50.0 - floor({gap} * 5))"
    return f"(CASE WHEN {place} > 0 THEN {score} ELSE 0.0 END)"


def word_sql(name: str, text: str) -> str:
    words = f"regexp_extract_all({name}, '[A-Z][^A-Z]*|^[^A-Z]+')"
    return f"len(list_filter({words}, lambda w: starts_with(lower(w), '{fold(text)}'))) > 0"


def initials_sql(name: str) -> str:
    return f"lower(regexp_replace({name}, '[^\\p{{Lu}}]', '', 'g'))"


def tokens_sql(name: str, text: str) -> str:
    if " " not in text:
        return "false"
    return " AND ".join(f"contains(lower({name}), '{fold(t)}')" for t in text.split(" ") if t)


def tier_sql(name: str, text: str) -> str:
    q = fold(text)
    return f"""CAST(CASE WHEN lower({name}) = '{q}' THEN 1000 WHEN starts_with(lower({name}), '{q}') THEN 500
      WHEN starts_with({initials_sql(name)}, '{q}') THEN 300 WHEN {word_sql(name, text)} THEN 200
      WHEN {tokens_sql(name, text)} THEN 150 WHEN contains(lower({name}), '{q}') THEN 100
      ELSE {subsequence_sql(name, text)} END AS DOUBLE)"""


def simple_sql(name: str, text: str) -> str:
    q = fold(text)
    return f"""CAST(CASE WHEN lower({name}) = '{q}' THEN 1.0 WHEN contains(lower({name}), '{q}') THEN 0.8
      WHEN {initials_sql(name)} = '{q}' THEN 0.7 ELSE 0.0 END AS DOUBLE)"""


def scored_sql(text: str, scorer: str) -> str:
    """members_v with score and shown name, as SQL."""
    if scorer == "tiered":
        short = "regexp_replace(name, 'Attribute$', '')"
        attribute, plain = tier_sql(f"({short})", text), tier_sql("name", text)
    else:
        short = "trim(replace(name, 'Attribute', ''))"
        attribute = f"CAST(CASE WHEN contains(lower({short}), '{fold(text)}') THEN 0.9 ELSE 0 END AS DOUBLE)"
        plain = simple_sql("name", text)
    return f"""(SELECT project, path, parent, member_type,
        CASE WHEN member_type = 'Attribute' THEN {short} ELSE name END AS name, line,
        CASE WHEN member_type = 'Attribute' THEN {attribute} ELSE {plain} END AS score FROM members_v)"""


RANK_SQL = "score DESC, name, project, path, line, parent, member_type"


@query(
    "tier_scores",
    f"WITH {V.MEMBERS} SELECT line, "
    + ", ".join(f"{tier_sql('name', q)} AS score_{i}" for i, q in enumerate(TIER_QUERIES))
    + " FROM members_v",
)
def tier_scores(spark, d):
    scores = [S.tier_score(F.col("name"), q).alias(f"score_{i}") for i, q in enumerate(TIER_QUERIES)]
    return V.members(spark, d).select("line", *scores)


@query(
    "tier_score_case_sensitive",
    f"""WITH {V.MEMBERS} SELECT line, CAST(CASE WHEN name = 'Ring' THEN 1000 WHEN starts_with(name, 'Ring') THEN 500
      WHEN starts_with(regexp_replace(name, '[^\\p{{Lu}}]', '', 'g'), 'Ring') THEN 300
      WHEN len(list_filter(regexp_extract_all(name, '[A-Z][^A-Z]*|^[^A-Z]+'), lambda w: starts_with(w, 'Ring'))) > 0 THEN 200
      WHEN contains(name, 'Ring') THEN 100
      ELSE {subsequence_sql('name', 'Ring').replace('lower(name)', 'name').replace("'r'", "'R'")} END AS DOUBLE) AS score
    FROM members_v""",
)
def tier_score_case_sensitive(spark, d):
    return V.members(spark, d).select("line", S.tier_score(F.col("name"), "Ring", True).alias("score"))


@query("initials_prefix", f"WITH {V.MEMBERS} SELECT line, starts_with({initials_sql('name')}, 's') AS hit FROM members_v")
def initials_prefix(spark, d):
    return V.members(spark, d).select("line", S.initials_prefix(F.col("name"), "s").alias("hit"))


@query("word_prefix", f"WITH {V.MEMBERS} SELECT line, {word_sql('name', 'wid')} AS hit FROM members_v")
def word_prefix(spark, d):
    return V.members(spark, d).select("line", S.word_prefix(F.col("name"), "wid").alias("hit"))


@query("all_tokens", f"WITH {V.MEMBERS} SELECT line, {tokens_sql('name', 'et g')} AS hit FROM members_v")
def all_tokens(spark, d):
    return V.members(spark, d).select("line", S.all_tokens(F.col("name"), "et g").alias("hit"))


@query(
    "substring_scores",
    f"WITH {V.MEMBERS} SELECT line, CASE WHEN contains(lower(name), 'olt') THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM members_v",
)
def substring_scores(spark, d):
    return V.members(spark, d).select("line", S.substring_score(F.col("name"), "olt").alias("score"))


@query(
    "subsequence_scores",
    f"WITH {V.MEMBERS} SELECT line, "
    + ", ".join(f"CAST({subsequence_sql('name', q)} AS DOUBLE) AS score_{i}" for i, q in enumerate(["r", "rg", "ldt", "slt"]))
    + " FROM members_v",
)
def subsequence_scores(spark, d):
    name = F.col("name")
    return V.members(spark, d).select(
        "line", *[S.subsequence_score(name, q).alias(f"score_{i}") for i, q in enumerate(["r", "rg", "ldt", "slt"])]
    )


@query(
    "simple_scores",
    f"WITH {V.MEMBERS} SELECT line, "
    + ", ".join(f"{simple_sql('name', q)} AS score_{i}" for i, q in enumerate(["hotbolt", "bolt", "HB", "no"]))
    + " FROM members_v",
)
def simple_scores(spark, d):
    name = F.col("name")
    return V.members(spark, d).select(
        "line", *[S.simple_score(name, q).alias(f"score_{i}") for i, q in enumerate(["hotbolt", "bolt", "HB", "no"])]
    )


@query(
    "attribute_scores",
    f"""WITH {V.MEMBERS} SELECT line, {tier_sql("(regexp_replace(name, 'Attribute$', ''))", 'hot')} AS tiered,
      CAST(CASE WHEN contains(lower(trim(replace(name, 'Attribute', ''))), 'hot') THEN 0.9 ELSE 0 END AS DOUBLE) AS simple
    FROM members_v WHERE member_type = 'Attribute'""",
)
def attribute_scores(spark, d):
    name = F.col("name")
    return Q.member_type_filter(V.members(spark, d), "Attribute").select(
        "line",
        S.attribute_score(name, "hot", scorer="tiered").alias("tiered"),
        S.attribute_score(name, "hot", scorer="simple").alias("simple"),
    )


@query(
    "page_attribute_scores",
    r"""WITH """ + V.PAGES + r""", tags AS (
      SELECT page_id, unnest(regexp_extract_all(content, '<[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?>')) AS tag FROM pages_v),
    attrs AS (SELECT page_id, unnest(regexp_extract_all(tag, '([A-Za-z-]+)="[^"]*"', 1)) AS name FROM tags)
    SELECT page_id, name, """ + tier_sql("name", "rf") + r""" AS score, count(*) AS uses FROM attrs GROUP BY ALL""",
)
def page_attribute_scores(spark, d):
    from lodeline.operators.structure import tag_attributes

    pages = V.pages(spark, d).select(F.col("page_id").alias("path"), "project", "content")
    return (
        tag_attributes(pages)
        .select(F.col("path").alias("page_id"), "name", S.attribute_score(F.col("name"), "rf", scorer="tiered").alias("score"))
        .groupBy("page_id", "name", "score")
        .agg(F.count("*").alias("uses"))
    )


@query(
    "member_hits",
    f"WITH {V.MEMBERS} SELECT project, path, parent, member_type, name, line, score FROM {scored_sql('ring', 'simple')} x WHERE score > 0",
)
def member_hits(spark, d):
    return Q.member_hits(V.members(spark, d), "ring").select(*Q.HIT_COLUMNS, "score")


@query(
    "member_type_filter",
    f"WITH {V.MEMBERS} SELECT project, path, name, line FROM members_v WHERE member_type = 'Property'",
)
def member_type_filter(spark, d):
    return Q.member_type_filter(V.members(spark, d), "Property").select("project", "path", "name", "line")


BODY_QUERY = "de la"
BODY_SQL = f"""SELECT project, path, class_name AS parent, 'Method' AS member_type, method_name AS name,
      line + len(string_split(left(lower(full_code), instr(lower(full_code), '{BODY_QUERY}') - 1), chr(10))) - 1 AS line,
      0.8::DOUBLE AS score
    FROM bodies_v WHERE contains(lower(full_code), '{BODY_QUERY}')"""


@query("body_hits", f"WITH {V.BODIES} {BODY_SQL}")
def body_hits(spark, d):
    return Q.body_hits(V.bodies(spark, d), BODY_QUERY)


CONTENT_QUERY = "ring the"
ALL_HITS_SQL = f"""SELECT project, path, parent, member_type, name, line, score
    FROM {scored_sql(CONTENT_QUERY, 'tiered')} x WHERE score > 0
    UNION ALL {BODY_SQL.replace(BODY_QUERY, CONTENT_QUERY)}"""


@query("name_and_body_hits", f"WITH {V.MEMBERS}, {V.BODIES} {ALL_HITS_SQL}")
def name_and_body_hits(spark, d):
    return Q.all_hits(V.members(spark, d), V.bodies(spark, d), CONTENT_QUERY, scorer="tiered")


def page_sql(hits: str, page: int, size: int) -> str:
    return f"""hits AS ({hits}), n AS (SELECT count(*) AS total FROM hits),
      p AS (SELECT total, greatest(1, CAST(ceil(total / {size}.0) AS INT)) AS pages FROM n)
    SELECT project, path, parent, member_type, name, line, score, least({page}, pages) AS page,
           pages AS total_pages, total AS total_results
    FROM (SELECT *, row_number() OVER (ORDER BY {RANK_SQL}) AS rn FROM hits), p
    WHERE rn > (least({page}, pages) - 1) * {size} AND rn <= least({page}, pages) * {size}"""


HITS_SIMPLE = f"SELECT project, path, parent, member_type, name, line, score FROM {scored_sql('ring', 'simple')} x WHERE score > 0"
HITS_TIERED = f"SELECT project, path, parent, member_type, name, line, score FROM {scored_sql('sr', 'tiered')} x WHERE score > 0"


@query("search_names", f"WITH {V.MEMBERS}, {page_sql(HITS_SIMPLE, 2, 25)}")
def search_names(spark, d):
    return Q.search(V.members(spark, d), V.bodies(spark, d), "ring", page=2, size=25)


@query("search_names_tiered", f"WITH {V.MEMBERS}, {page_sql(HITS_TIERED, 1, 20)}")
def search_names_tiered(spark, d):
    return Q.search(V.members(spark, d), None, "SR", scorer="tiered")


@query("search_content", f"WITH {V.MEMBERS}, {V.BODIES}, {page_sql(ALL_HITS_SQL, 1, 200)}")
def search_content(spark, d):
    return Q.search(V.members(spark, d), V.bodies(spark, d), CONTENT_QUERY, scorer="tiered", size=500)


@query(
    "search_one_project",
    f"WITH {V.MEMBERS}, {page_sql(HITS_SIMPLE + chr(32) + 'AND project = ' + repr('PROMO'), 999, 20)}",
)
def search_one_project(spark, d):
    """A page past the end shows the last page."""
    return Q.search(V.members(spark, d), None, "ring", project="PROMO", page=999)


@query(
    "search_summary",
    f"""WITH {V.MEMBERS}, {V.BODIES}, hits AS ({ALL_HITS_SQL}), scanned AS (
      SELECT project, path FROM members_v UNION SELECT project, path FROM hits),
    s AS (SELECT (SELECT count(*) FROM hits) AS total_results, (SELECT count(*) FROM scanned) AS files_scanned,
                 (SELECT count(DISTINCT project) FROM scanned) AS projects_searched)
    SELECT total_results, files_scanned, projects_searched,
           greatest(1, CAST(ceil(total_results / 20.0) AS BIGINT)) AS total_pages, CAST(1 AS BIGINT) AS page,
           1 < greatest(1, CAST(ceil(total_results / 20.0) AS BIGINT)) AS has_next FROM s""",
)
def search_summary(spark, d):
    return Q.search_summary(V.members(spark, d), V.bodies(spark, d), CONTENT_QUERY, scorer="tiered")


@query(
    "grep_summary",
    f"""WITH {V.FILES}, {V.LINES}, h AS (SELECT project, path FROM lines_v WHERE contains(lower(line), 'tion'))
    SELECT project, count(*) AS hits, count(DISTINCT path) AS files FROM h GROUP BY project""",
)
def grep_summary(spark, d):
    from lodeline.operators.lines import grep_counts

    return (
        grep_counts(V.files(spark, d), "tion", "project", "path")
        .groupBy("project")
        .agg(F.sum("match_count").alias("hits"), F.count("*").alias("files"))
    )


@query(
    "hits_by_project_type",
    f"""WITH {V.MEMBERS}, t AS (SELECT project, member_type, count(*) AS hits
      FROM {scored_sql('ring', 'simple')} x WHERE score > 0 GROUP BY ALL)
    SELECT project, member_type, hits, CAST(sum(hits) OVER (PARTITION BY project) AS BIGINT) AS project_hits,
      list_position(['Class', 'Interface', 'Method', 'Property', 'Field', 'Enum', 'Struct', 'Attribute'], member_type) AS type_rank
    FROM t""",
)
def hits_by_project_type(spark, d):
    return Q.hits_by_project_type(Q.member_hits(V.members(spark, d), "ring"))


@query("name_contains", f"WITH {V.MEMBERS} SELECT name, line FROM members_v WHERE contains(lower(name), 'dgi')")
def name_contains(spark, d):
    return Q.name_hits(V.members(spark, d), "  DGi ", "name").select("name", "line")


@query(
    "any_column_contains",
    "SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE contains(lower(p_name), 'old') OR contains(lower(p_brand), 'old') OR contains(lower(p_type), 'old')",
)
def any_column_contains(spark, d):
    return Q.name_hits(V.table(spark, d, "part"), "OLD", "p_name", "p_brand", "p_type").select(
        "p_partkey", "p_name", "p_brand", "p_type"
    )


# Pages ----------------------------------------------------------------------


@query(
    "page_numbers",
    f"""WITH {V.MEMBERS} SELECT name, line, rn AS place, CAST(ceil(rn / 50.0) AS BIGINT) AS page
    FROM (SELECT *, row_number() OVER (ORDER BY name, line) AS rn FROM members_v) x""",
)
def page_numbers(spark, d):
    rows = V.members(spark, d).select("name", "line")
    return O.with_page_number(rows, [F.asc("name"), F.asc("line")], 50)


@query(
    "page_clamped",
    f"""WITH {V.MEMBERS}, n AS (SELECT count(*) AS total FROM members_v),
      p AS (SELECT total, CAST(ceil(total / 30.0) AS INT) AS pages FROM n)
    SELECT name, line, pages AS page, pages AS total_pages, total AS total_results
    FROM (SELECT *, row_number() OVER (ORDER BY name, line) AS rn FROM members_v), p WHERE rn > (pages - 1) * 30""",
)
def page_clamped(spark, d):
    rows = V.members(spark, d).select("name", "line")
    return O.page_clamped(rows, [F.asc("name"), F.asc("line")], page=10**6, size=30)


@query(
    "page_unclamped",
    f"""WITH {V.MEMBERS}, n AS (SELECT count(*) AS total FROM members_v)
    SELECT name, line, 3 AS page, CAST(ceil(total / 50.0) AS INT) AS total_pages, total AS total_files,
           3 < ceil(total / 50.0) AS has_next, true AS has_previous
    FROM members_v, n ORDER BY name, line LIMIT 50 OFFSET 100""",
)
def page_unclamped(spark, d):
    """A page size out of range becomes the default."""
    rows = V.members(spark, d).select("name", "line")
    return O.page_unclamped(rows, [F.asc("name"), F.asc("line")], page=3, size=1000)


@query(
    "far_page",
    f"""WITH {V.CALLS} SELECT path, line, callee_method FROM (
      SELECT *, row_number() OVER (ORDER BY callee_method, path, line, caller_class, caller_method, callee_class) AS rn FROM calls_v) x
    WHERE rn > 5000 AND rn <= 5200""",
)
def far_page(spark, d):
    """A page far down a large ordering, cut from exact row numbers."""
    order = [F.asc(c) for c in ("callee_method", "path", "line", "caller_class", "caller_method", "callee_class")]
    return O.take_page(V.calls(spark, d), order, 26, 200).select("path", "line", "callee_method")


@query("sort_by_name", f"WITH {V.MEMBERS} SELECT name, project, path, line FROM members_v ORDER BY ALL")
def sort_by_name(spark, d):
    rows = V.members(spark, d).select("name", "project", "path", "line")
    return O.sort_by_name(rows, "name", "project", "path", "line")


# Lookups --------------------------------------------------------------------

REQUESTS = """req AS (
  SELECT DISTINCT 'o/' || o_orderkey || '.cs' AS path, 'M' || (o_custkey % 9) AS name,
         CASE WHEN o_custkey % 2 = 0 THEN 'S' || (o_custkey % 100) ELSE '' END AS wanted_class FROM orders)"""


def requests(spark, d):
    cust = F.col("o_custkey")
    return V.table(spark, d, "orders").select(
        V.text("o/", F.col("o_orderkey"), ".cs").alias("path"),
        V.text("M", cust % 9).alias("name"),
        F.when(cust % 2 == 0, V.text("S", cust % 100)).alias("class_name"),
    )


@query(
    "lookup_many",
    f"""WITH {V.METHODS}, {REQUESTS}, f AS (
      SELECT m.path, m.method_name, r.wanted_class, m.class_name, m.line,
             count(*) OVER (PARTITION BY m.path, m.method_name, r.wanted_class) AS matches
      FROM methods_v m JOIN req r ON r.path = m.path AND r.name = m.method_name
      WHERE r.wanted_class = '' OR r.wanted_class = m.class_name)
    SELECT *, wanted_class = '' AND matches > 1 AS ambiguous FROM f""",
)
def lookup_many(spark, d):
    return Q.lookup_many(V.methods(spark, d), requests(spark, d))


@query(
    "not_found",
    f"""WITH {V.METHODS}, {REQUESTS} SELECT path, name FROM req
    WHERE (path, name) NOT IN (SELECT (path, method_name) FROM methods_v)""",
)
def not_found(spark, d):
    return Q.not_found(V.methods(spark, d), requests(spark, d)).select("path", "name")


@query("available_names", f"WITH {V.METHODS} SELECT DISTINCT path, method_name AS available FROM methods_v")
def available_names(spark, d):
    return Q.available_names(V.methods(spark, d), "path")


# passages of the benchmark, words of parts, and short pieces of words
ASKED = """asked AS (SELECT DISTINCT query FROM (SELECT substr(text, 9, 11) AS query FROM benchmark UNION ALL SELECT upper(split_part(p_name, ' ', 1)) FROM part
  UNION ALL SELECT substr(p_name, 1, 2) FROM part UNION ALL SELECT substr(text, 2, 1) FROM benchmark) WHERE length(query) > 0)"""


def asked(spark, d):
    name, passage = V.table(spark, d, "part").select("p_name"), V.table(spark, d, "benchmark").select("text")
    parts = [passage.select(F.substring("text", 9, 11).alias("query")), name.select(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("query")),
             name.select(F.substring("p_name", 1, 2).alias("query")), passage.select(F.substring("text", 2, 1).alias("query"))]
    every = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return every.where(F.length("query") > 0).distinct()


def posted_documents(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    posted = stored(P.postings(docs, "doc_id", "text"))
    return docs, posted, stored(P.gram_counts(posted))


@query(
    "postings_search",
    f"""WITH {ASKED} SELECT query, doc_id FROM asked JOIN documents ON contains(lower(text), lower(query))""",
)
def postings_search(spark, d):
    docs, posted, counts = posted_documents(spark, d)
    return P.search_texts(asked(spark, d), docs, posted, counts, "doc_id", "text")


@query(
    "postings_share",
    f"""WITH {ASKED}, g AS (SELECT DISTINCT query, substr(lower(query), i, 3) AS gram FROM asked, range(1, 12) r(i) WHERE i + 2 <= length(query)),
    c AS (SELECT query, gram, count(doc_id) AS n FROM g LEFT JOIN documents ON contains(lower(text), gram) GROUP BY ALL),
    p AS (SELECT query, gram FROM c QUALIFY row_number() OVER (PARTITION BY query ORDER BY n, gram) <= 4),
    m AS (SELECT query, doc_id FROM p JOIN documents ON contains(lower(text), gram) GROUP BY query, doc_id
      HAVING count(*) = (SELECT count(*) FROM p q WHERE q.query = p.query))
    SELECT query, count(doc_id) AS candidates, count(doc_id)::DOUBLE / (SELECT count(*) FROM documents) AS share
    FROM (SELECT query FROM asked WHERE length(query) >= 3) LEFT JOIN m USING (query) GROUP BY query""",
)
def postings_share(spark, d):
    docs, posted, counts = posted_documents(spark, d)
    return P.share_read(asked(spark, d), docs, posted, counts, "doc_id")


@query(
    "postings_update",
    """WITH now AS (SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 10 = 4 THEN 'changed ' || doc_id ELSE text END AS text FROM documents)
    SELECT doc_id, len(list_distinct(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])))::BIGINT AS grams
    FROM (SELECT doc_id, string_split(lower(text) || chr(0) || chr(0), '') AS c FROM now WHERE length(text) > 0)""",
)
def postings_update(spark, d):
    docs, posted, _ = posted_documents(spark, d)
    key = F.col("doc_id")
    changed = docs.where((key % 10 == 3) | (key % 10 == 4)).select("doc_id", F.when(key % 10 == 4, V.text("changed ", key)).alias("text"))
    return P.update_postings(posted, changed, "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("grams"))

"""Text search queries. Names of parts with their brand stand in for names of places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query, table
from ..functions import text as fn
from ..operators import search as op

NAMES = "(select p_partkey as id, lower(replace(p_name || ' ' || p_brand || ' ' || p_type, '#', ' ')) as name, p_size, p_retailprice from part)"
#: Asked for: words of a name, the last one possibly cut off.
ASKED = ("small ring", "blue bolt brand 4", "red wid", "gear brand 1", "hot gizmo brand 13 eco")
REQUESTS = ("small ring", "smal ring", "blue bolt brand 4", "red wdiget", "hot gizom economy", "brnad 1 stadnard", "nothing alike")
WRONG = ("wdiget", "gizom", "brnad", "econmoy", "smal", "stadnard", "promoo")


def names(spark, d):
    p = table(spark, d, "part")
    name = F.lower(F.replace(F.concat_ws(" ", "p_name", "p_brand", "p_type"), F.lit("#"), F.lit(" ")))
    return p.select(F.col("p_partkey").alias("id"), name.alias("name"), "p_size", "p_retailprice")


def asked(spark, values):
    return spark.createDataFrame([(v,) for v in values], "query string")


def values(v) -> str:
    return ", ".join(f"('{x}')" for x in v)


WORDS = f"(select distinct id, unnest(string_split(name, ' ')) as term from {NAMES})"

def hits(source: str) -> str:
    """Names that hold all words of ``text``, the last as a prefix, of a source ``query, text``."""
    return f"""(with q as (select query, string_split(text, ' ') as w from {source}),
    p as (select query, len(w) as n, unnest(range(1, len(w) + 1)) as place, unnest(w) as word from q),
    h as (select query, n, id, count(distinct place) as found from p join {WORDS} t
        on (place < n and term = word) or (place = n and starts_with(term, word)) group by 1, 2, 3)
    select query, id from h where found = n)"""


HITS = hits(f"(select query, query as text from (values {values(ASKED)}) v(query))")


@query("""
select doc_id, md5(trim(regexp_replace(strip_accents(replace(lower(text), 'ß', 'ss')), '[^\\p{L}\\p{N}]+', ' ', 'g'))) as normal_md5 from documents
""")
def normal_texts(spark, d):
    """Normal form of whole texts, as a digest."""
    return table(spark, d, "documents").select("doc_id", F.md5(fn.normal(F.col("text"))).alias("normal_md5"))


@query(f"select term, count(*) as held, min(id) as first from {WORDS} group by 1")
def term_index(spark, d):
    return op.index_terms(names(spark, d), "id", "name").groupBy("term").agg(F.count("*").alias("held"), F.min("id").alias("first"))


@query(f"""
with t as (select distinct term from {WORDS} where length(term) >= 3), g as (select distinct term, unnest(list_transform(range(1, length(term) - 1), lambda i: substr(term, i, 3))) as gram from t)
select gram, count(*) as terms from g group by 1
""")
def trigram_index(spark, d):
    t = op.index_terms(names(spark, d), "id", "name").select("term").distinct()
    return t.select(F.explode(fn.grams(F.col("term"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("terms"))


@query(f"select query, id from {HITS}")
def all_words_search(spark, d):
    """Names that hold all words, the last as a prefix."""
    return op.all_words(asked(spark, ASKED), op.index_terms(names(spark, d), "id", "name"))


@query(f"""
with l as (select distinct term from {WORDS} where length(term) between 5 and 80),
e as (select query, term, damerau_levenshtein(query, term)::int as edits, case when length(query) < 5 then 0 when length(query) < 8 then 1 else 2 end as budget
    from l, (values {values(WRONG)}) v(query)),
r as (select *, row_number() over (partition by query order by edits, term) as rank from e where edits <= budget)
select query, term, edits, rank from r where rank <= 8
""")
def fuzzy_correction(spark, d):
    return op.corrections(asked(spark, WRONG), op.lexicon(op.index_terms(names(spark, d), "id", "name")))


@query(f"""
with s as (select h.query, n.id, case when name = query then 100 when replace(name, ' ', '') = replace(query, ' ', '') then 98
        when starts_with(name, query) then 88 else 74 end + 12 / (1 + p_size / 20.0::double) + least((p_retailprice - 900) / 20, 8) as score
    from {HITS} h join {NAMES} n on n.id = h.id),
r as (select *, row_number() over (partition by query order by score desc, id) as rank from s)
select query, id, round(score, 9) as score, rank from r where rank <= 10
""")
def scored_search(spark, d):
    """Candidates by score: kind of match, nearness (the size as km), prominence (the price)."""
    n = names(spark, d)
    hits = op.all_words(asked(spark, ASKED), op.index_terms(n, "id", "name")).join(n.hint("merge"), "id")
    s = op.score(op.tier(F.col("query"), F.col("name")), F.lit(0), F.col("p_size"), (F.col("p_retailprice") - 900) / 20)
    return op.ranked(hits.withColumn("score", s), "query", 10).select("query", "id", F.round("score", 9).alias("score"), "rank")


@query("""
with q as (select 'small ring ' || n as query, 'small ring' as name, n::varchar as house from range(1, 61) t(n)),
s as (select p_name as name, p_brand as street, p_size::varchar as house from part),
a as (select distinct q.query, s.street, q.house, s.name from q join s using (name)),
e as (select distinct a.query, a.street, a.house from a join s on s.street = a.street and s.house = a.house and s.name = a.name)
select query, street, house, null::varchar as note from e
union all select query, street, null, 'number not found' from a where query not in (select query from e)
""")
def house_number_search(spark, d):
    """Streets are brands of one name, houses its sizes."""
    p = table(spark, d, "part").where("p_name = 'small ring'")
    q = spark.range(1, 61).select(F.concat(F.lit("small ring "), F.col("id").cast("string")).alias("query"))
    streets = p.select(F.col("p_name").alias("name"), F.col("p_brand").alias("street")).distinct()
    return op.house_numbers(q, streets, p.select(F.col("p_brand").alias("street"), F.col("p_size").cast("string").alias("house")))


@query("""
select distinct p_name, array_to_string(w[i:i + k - 1], '') as span
from (select distinct p_name, string_split(p_name, ' ') as w from part), range(1, 9) a(i), range(1, 9) b(k) where i + k - 1 <= len(w)
""")
def token_spans(spark, d):
    """All runs of words of a name, joined."""
    p = table(spark, d, "part").select("p_name").distinct()
    return p.select("p_name", F.explode(fn.spans(fn.words(F.col("p_name")))).alias("span"))


@query("""
with w as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from documents)
select term, count(*) as docs from w group by 1 order by docs desc, term limit 100
""")
def common_terms(spark, d):
    """The hundred words that most documents hold."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    w = table(spark, d, "documents").select(F.explode(found).alias("term"))
    return w.groupBy("term").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "term").limit(100)


@query(f"""
with a as (select query, query as text from (values {values(REQUESTS)}) v(query)),
h as materialized {hits("a")},
w as (select query, unnest(range(1, len(string_split(query, ' ')) + 1)) as place, unnest(string_split(query, ' ')) as word from a where query not in (select query from h)),
l as (select distinct term from {WORDS} where length(term) between 5 and 80),
e as (select query, place, term, damerau_levenshtein(word, term)::int as edits from w, l
    where damerau_levenshtein(word, term) <= case when length(word) < 5 then 0 when length(word) < 8 then 1 else 2 end),
b as (select query, place, arg_min(term, (edits, term)) as term, min(edits) as edits from e group by 1, 2),
f as materialized (select w.query, string_agg(coalesce(term, word), ' ' order by place) as text, sum(coalesce(edits, 0)) as edits from w left join b using (query, place) group by 1),
c as (select query, id, query as read_as, 0 as edits, false as fuzzy from h
    union all select query, id, text, edits, true from {hits("f")} join f using (query)),
s as (select c.query, c.id, read_as, case when fuzzy then 58 when name = query then 100 when replace(name, ' ', '') = replace(query, ' ', '') then 98
        when starts_with(name, query) then 88 else 74 end - 8 * edits + 12 / (1 + p_size / 20.0::double) + least((p_retailprice - 900) / 20, 8) as score
    from c join {NAMES} n on n.id = c.id),
r as (select *, row_number() over (partition by query order by score desc, id) as rank from s)
select query, id, read_as, round(score, 9) as score, rank from r where rank <= 10
""")
def place_search(spark, d):
    """Requests to ranked rows: all words, else corrected words, then scores."""
    n = names(spark, d).select("id", "name", F.col("p_size").alias("km"), ((F.col("p_retailprice") - 900) / 20).alias("prominence"))
    out = op.resolved(asked(spark, REQUESTS), n, 10)
    return out.select("query", "id", "read_as", F.round("score", 9).alias("score"), "rank")

"""Facts queries: customers with their first order stand for laureates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.functions import text as T
from lexloom.operators import facts as X
from lexloom.operators import filters as P
from lexloom.operators import merge as M
from lexloom.session import expect_long_rows, materialize, table


def facts_table(spark, sf):
    first = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("d"), F.max("o_orderdate").cast("date").alias("e"))
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    return c.join(first, F.col("o_custkey") == key).select(
        key.alias("ord"),
        F.col("c_name").alias("full_name"),
        F.year("d").alias("year_awarded"),
        F.when(key % 2 == 0, "Female").otherwise("Male").alias("gender"),
        F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("country"),
        F.col("c_mktsegment").alias("category"),
        F.concat(F.lit("for work on "), F.lower("c_mktsegment")).alias("prize_motivation"),
        F.col("d").cast("string").alias("date_of_birth"),
        F.when(key % 3 == 0, F.col("e").cast("string")).alias("date_of_death"),
    )


def _questions(spark, sf):
    f = facts_table(spark, sf)
    n = F.replace("full_name", F.lit("#"), F.lit(" "))
    y = F.col("year_awarded").cast("string")
    forms = [
        ("When did ", n, " win?"), ("Who won the prize in ", y, "?"), ("What country is ", n, " from?"), ("How many women won since ", y, "?"),
        ("Which country has won the most prizes?",), ("Who was the last female winner?",), ("How many laureates are from ", F.col("country"), "?"),
        ("What was the prize motivation for ", n, "?"), ("When was ", n, " died?"), ("Which years was the prize not awarded?",),
        ("Who was the first ", F.col("country"), " laureate?"), ("How many men have won?",), ("Please say something nice about ", n, "."),
    ]
    text = F.element_at(F.array(*[F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in form]) for form in forms]), (F.col("ord") % len(forms) + 1).cast("int"))
    return f.select(F.col("ord").alias("question_id"), text.alias("question"))


def _spaced(spark, sf):
    return facts_table(spark, sf).withColumn("full_name", F.replace("full_name", F.lit("#"), F.lit(" ")))


def facts_flatten(spark, sf):
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    nested = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    whole = table(spark, sf, "orders").join(nested, F.col("o_orderkey") == F.col("l_orderkey"))
    return P.flatten(whole, "items", ["o_orderkey", "o_orderstatus"])


def facts_count_since(spark, sf):
    f = facts_table(spark, sf)
    return X.count_where(f, (F.col("category") == "MACHINERY") & (F.col("year_awarded") >= 1996))


def facts_mode_country(spark, sf):
    return X.most_common(facts_table(spark, sf), "country", "ord", 5)


def facts_first_last(spark, sf):
    f = table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return X.first_last(f, "c_mktsegment", "o_orderdate", "o_orderkey", ["o_orderkey", "c_name"])


def facts_names_per_year(spark, sf):
    named = X.names_by(facts_table(spark, sf), "year_awarded", "full_name", "ord")
    return named.select("year_awarded", F.size("names").alias("n"), F.md5(F.array_join("names", ",")).alias("names_md5"))


def facts_missing_days(spark, sf):
    days = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_orderdate").cast("date").alias("day"))
    return X.missing_between(days, "day").select(F.col("missing").cast("string").alias("missing"))


def facts_distinct(spark, sf):
    return table(spark, sf, "orders").select("o_orderpriority", "o_orderstatus").distinct()


def facts_entity_lookup(spark, sf):
    return P.entity_lookup(table(spark, sf, "part"), "p_name", "Widget", "p_partkey").select("p_partkey", "p_name", "p_brand")


def facts_search(spark, sf):
    hit = P.search(table(spark, sf, "documents"), "text", "EAND")
    return hit.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def facts_filters(spark, sf):
    docs = table(spark, sf, "documents")
    one = P.apply_filters(docs, {"lang": "en", "source": ["src1", "src2"], "no_such_column": None})
    return one.select("doc_id", "lang", "source")


def facts_by_id(spark, sf):
    return P.get_by_id(table(spark, sf, "events"), "event_id", 77).select("event_id", "event_type", "value")


def facts_count_country(spark, sf):
    counted = facts_table(spark, sf).groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("country", F.concat(F.col("n").cast("string"), F.lit(" laureates are from "), F.initcap("country"), F.lit(".")).alias("answer"))


LANDS = ("France", " sweden ", "USA", "United Kingdom", "Soviet Union", "Chile", "Japan", "Atlantis")


def facts_country_flag(spark, sf):
    """Customers live in countries of the world by their nation's number; the last of these is no country."""
    named = F.element_at(F.array(*map(F.lit, LANDS)), (F.col("c_nationkey") % len(LANDS) + 1).cast("int"))
    return X.with_flag(table(spark, sf, "customer").select("c_custkey", named.alias("country")), "country", X.country_dimension(spark)).groupBy("country", "flag").agg(F.count(F.lit(1)).alias("n"))


def facts_texts(spark, sf):
    """Customers stand for entities, orders for texts by (year, name), and dearest orders for yearly ones."""
    e = facts_table(spark, sf).select(F.col("year_awarded").alias("year"), T.last_name(F.col("full_name")).alias("last_name"), "full_name")
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    own = o.select(F.year("o_orderdate").alias("year"), T.last_name(F.col("c_name")).alias("last_name"), F.col("o_orderkey").alias("text_id"))
    shared = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("text_id"))
    return X.attach_texts(e, own, shared).select("year", "last_name", "full_name", "text_id", "kind")


def facts_answers(spark, sf):
    expect_long_rows(spark)
    return X.answer_facts(materialize(_questions(spark, sf)), materialize(_spaced(spark, sf)))


def rule_match(spark, sf):
    found = X.match_rules(_questions(spark, sf))
    return found.select("question_id", F.coalesce("rule", F.lit("none")).alias("rule"))


SCOPE_NAMES = ("Customer#", "Tomas Okafor-Lind", "Eugene O'Neill", "Łucja Żak-Ørsted", "José Ñandú ")


def entity_scope(spark, sf):
    """Names with hyphens, apostrophes and letters beyond ASCII; questions name one as a whole and one by its last name."""
    key = F.col("c_custkey")
    full = F.concat(F.element_at(F.array(*map(F.lit, SCOPE_NAMES)), (key % len(SCOPE_NAMES) + 1).cast("int")), key.cast("string"))
    names = table(spark, sf, "customer").select(key, full.alias("full_name"))
    other = names.select((F.col("c_custkey") - 3).alias("c_custkey"), F.element_at(F.split("full_name", " "), -1).alias("last"))
    asked = names.join(other, "c_custkey", "left").select(
        key.alias("question_id"),
        F.when(key % 5 == 0, F.concat(F.lit("What did "), F.coalesce("last", F.lit("nobody")), F.lit(" write?"))).otherwise(F.concat(F.lit("Compare ("), F.upper("full_name"), F.lit(") and "), F.coalesce("last", F.lit("nobody")), F.lit("'s book."))).alias("question"),
    )
    return X.scoped_entities(asked, names).select("question_id", F.array_join("entities", "|").alias("entities"))


def facts_upsert(spark, sf):
    old = table(spark, sf, "customer").where("c_custkey % 10 <> 3").select(F.year(F.lit("2000-01-01")).alias("year"), F.upper("c_name").alias("name"), "c_nationkey", "c_acctbal", "c_mktsegment", F.lit("old").alias("last_updated"))
    new = table(spark, sf, "customer").where("c_custkey % 10 > 1").select(
        F.lit(2000).alias("year"), F.concat(F.lit(" "), "c_name").alias("name"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey") + 1).alias("c_nationkey"), (F.col("c_acctbal") + 1).alias("c_acctbal")
    )
    merged = M.upsert(old, new, ["year", "name"], F.lit("new"), {"name": F.lower(F.trim("name"))})
    return merged.select("year", F.lower(F.trim("name")).alias("name"), "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal"), "c_mktsegment", "last_updated")


def facts_upsert_conflicts(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    new = old.select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey") + 1).alias("c_nationkey"), F.when(F.col("c_custkey") % 5 == 0, F.lit("NEW")).alias("c_mktsegment"))
    return M.upsert_conflicts(old, new, ["c_custkey"], ["c_nationkey", "c_mktsegment"])


def facts_overrides(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    special = table(spark, sf, "part").where("p_size > 45").select("p_partkey", F.concat(F.lit("large "), "p_name").alias("p_name"))
    return M.with_overrides(parts, special, ["p_partkey"], ["p_name"])


def facts_titles(spark, sf):
    docs = table(spark, sf, "documents")
    have = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, T.first_line(F.col("text"))).alias("title"))
    found = docs.select("doc_id", T.first_line(F.col("text")).alias("title"))
    return M.enrich(have, found, ["doc_id"], "title").select("doc_id", F.md5("title").alias("title_md5"), "changed")


def sources_zip(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.length("text").alias("n")))).alias("t"))
    shaped = turns.select("conv_id", F.when(F.col("conv_id") % 5 > 0, F.transform("t", lambda x: x["role"])).alias("items"), F.filter(F.transform("t", lambda x: x["n"]), lambda x, i: i < 3).alias("scores"))
    return M.zip_sources(shaped, ["conv_id"], "items", "scores")


def reconcile(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return M.reconcile({"documents": docs, "labels": labels}, "doc_id")


def missing_files(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"))
    there = table(spark, sf, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"))
    return docs.join(there, "file", "left_anti")


QUERIES = {f.__name__: f for f in (facts_flatten, facts_count_since, facts_mode_country, facts_first_last, facts_names_per_year, facts_missing_days, facts_distinct, facts_entity_lookup, facts_search, facts_filters, facts_by_id, facts_count_country, facts_country_flag, facts_texts, facts_answers, rule_match, entity_scope, facts_upsert, facts_upsert_conflicts, facts_overrides, facts_titles, sources_zip, reconcile, missing_files)}

_FACTS = """
with o as (select o_custkey, min(o_orderdate)::date as d, max(o_orderdate)::date as e from orders group by 1),
f as (select c_custkey as ord, c_name as full_name, year(d)::int as year_awarded, case when c_custkey % 2 = 0 then 'Female' else 'Male' end as gender,
             lower(replace(n_name, '_', ' ')) as country, c_mktsegment as category, 'for work on ' || lower(c_mktsegment) as prize_motivation,
             d::varchar as date_of_birth, case when c_custkey % 3 = 0 then e::varchar end as date_of_death
      from customer join nation on c_nationkey = n_nationkey join o on o_custkey = c_custkey)"""

_ANSWERS = (
    _FACTS
    + """,
g as (select *, replace(full_name, '#', ' ') as n, ord % 13 as form from f),
women as (select y, (select count(*) from f where gender = 'Female' and year_awarded >= y) as n from (select distinct year_awarded as y from f)),
names as (select year_awarded as y, string_agg(replace(full_name, '#', ' '), ', ' order by ord) as ns from f group by 1),
top as (select country, count(*) as n from f group by 1 order by n desc, min(ord) limit 1),
lastf as (select arg_max(n, year_awarded::bigint * 1000000000 + ord) as n, max(year_awarded) as y from g where gender = 'Female'),
per as (select country, count(*) as n, arg_min(n, year_awarded::bigint * 1000000000 + ord) as first_name, min(year_awarded) as first_year from g group by 1),
gaps as (select string_agg(y::varchar, ', ' order by y) as ys from (select unnest(range((select min(year_awarded) from f), (select max(year_awarded) from f) + 1)) as y) where y not in (select year_awarded from f)),
a as (select ord as question_id,
  case form when 0 then n || ' won in ' || year_awarded || '.'
  when 1 then 'In ' || year_awarded || ', the prize went to ' || (select ns from names where y = year_awarded) || '.'
  when 2 then n || ' is from ' || country || '.'
  when 3 then (select w.n from women w where w.y = year_awarded) || ' women won the prize since ' || year_awarded || '.'
  when 4 then (select country || ' has won the most, with ' || n || ' laureates.' from top)
  when 5 then (select 'The last female laureate was ' || n || ' in ' || y || '.' from lastf)
  when 6 then (select p.n from per p where p.country = g.country) || ' laureates are from ' || country || '.'
  when 7 then n || ' was recognised ' || prize_motivation || '.'
  when 8 then case when date_of_death is null then 'No date of that kind is known for ' || n || '.' else n || ' was died on ' || date_of_death || '.' end
  when 9 then coalesce((select 'The prize was not awarded in: ' || ys || '.' from gaps where ys is not null), 'Every year has at least one laureate.')
  when 10 then (select 'The first ' || g.country || ' laureate was ' || first_name || ' in ' || first_year || '.' from per p where p.country = g.country)
  when 11 then (select count(*) from f where gender = 'Male') || ' men have won.'
  end as answer,
  ['award_year_by_name', 'winner_in_year', 'country_of_laureate', 'count_women_since_year', 'most_awarded_country', 'first_last_gender_laureate',
   'count_laureates_from_country', 'prize_motivation_by_name', 'birth_death_date_by_name', 'years_with_no_award', 'first_last_country_laureate',
   'count_gender_laureates', 'none'][form + 1] as rule
  from g)"""
)

_LAND = "[" + ", ".join(f"'{x}'" for x in LANDS) + "][c_nationkey % 8 + 1]"
SQL = {
    "facts_flatten": "select o_orderkey, o_orderstatus, (row_number() over (partition by o_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) - 1)::int as ord, l_linenumber, l_partkey, l_suppkey, l_quantity from orders join lineitem on o_orderkey = l_orderkey",
    "facts_count_since": _FACTS + " select count(*) as n from f where category = 'MACHINERY' and year_awarded >= 1996",
    "facts_mode_country": _FACTS + " select country, count(*) as n, min(ord) as first_seen from f group by 1 order by n desc, first_seen limit 5",
    "facts_first_last": """with j as (select *, row_number() over (partition by c_mktsegment order by o_orderdate, o_orderkey) as a, row_number() over (partition by c_mktsegment order by o_orderdate desc, o_orderkey desc) as b from customer join orders on c_custkey = o_custkey)
select c_mktsegment, max(o_orderkey) filter (a = 1) as first_o_orderkey, max(c_name) filter (a = 1) as first_c_name, max(o_orderkey) filter (b = 1) as last_o_orderkey, max(c_name) filter (b = 1) as last_c_name from j group by 1""",
    "facts_names_per_year": _FACTS + " select year_awarded, count(*)::int as n, md5(string_agg(full_name, ',' order by ord)) as names_md5 from f group by 1",
    "facts_missing_days": "with d as (select distinct o_orderdate::date as d from orders where o_totalprice > 400000) select x::date::varchar as missing from (select unnest(generate_series((select min(d) from d)::timestamp, (select max(d) from d)::timestamp, interval 1 day)) as x) where x::date not in (select d from d)",
    "facts_distinct": "select distinct o_orderpriority, o_orderstatus from orders",
    "facts_entity_lookup": "select p_partkey, p_name, p_brand from part where contains(lower(p_name), 'widget') order by p_partkey limit 1",
    "facts_search": "select lang, count(*) as n, min(doc_id) as first_id from documents where contains(lower(text), 'eand') group by 1",
    "facts_filters": "select doc_id, lang, source from documents where lang = 'en' and source in ('src1', 'src2')",
    "facts_by_id": "select event_id, event_type, value from events where event_id = 77",
    "facts_count_country": _FACTS + " select country, count(*) || ' laureates are from ' || upper(country[1]) || country[2:] || '.' as answer from f group by 1",
    "facts_country_flag": "select " + _LAND + " as country, case c_nationkey % 8 when 0 then '🇫🇷' when 1 then '🇸🇪' when 2 then '🇺🇸' when 3 then '🇬🇧' when 4 then '🇷🇺' when 5 then '🇨🇱' when 6 then '🇯🇵' end as flag, count(*) as n from customer group by 1, 2",
    "facts_texts": _FACTS
    + """, t as (select year(o_orderdate)::int as year, lower(c_name) as last_name, o_orderkey as text_id from orders join customer on o_custkey = c_custkey),
s as (select year(o_orderdate)::int as year, o_orderkey as text_id from orders qualify row_number() over (partition by year(o_orderdate) order by o_totalprice desc, o_orderkey desc) = 1)
select f.year_awarded as year, lower(full_name) as last_name, full_name, text_id, 'own' as kind from f join t on t.year = f.year_awarded and t.last_name = lower(f.full_name)
union all select f.year_awarded, lower(full_name), full_name, text_id, 'shared' from f join s on s.year = f.year_awarded""",
    "facts_answers": _ANSWERS + " select question_id, rule, answer from a where rule <> 'none'",
    "rule_match": _ANSWERS + " select question_id, rule from a",
    "entity_scope": r"""with n as (select c_custkey, [""" + ", ".join("'" + x.replace("'", "''") + "'" for x in SCOPE_NAMES) + r"""][c_custkey % 5 + 1] || c_custkey as full_name from customer),
l as (select *, lower(full_name) as low, lower(string_split(full_name, ' ')[-1]) as last from n),
q as (select c_custkey as question_id, lower(case when c_custkey % 5 = 0 then 'What did ' || coalesce(o.last_, 'nobody') || ' write?' else 'Compare (' || upper(full_name) || ') and ' || coalesce(o.last_, 'nobody') || '''s book.' end) as q
      from n left join (select c_custkey - 3 as c_custkey, string_split(full_name, ' ')[-1] as last_ from n) o using (c_custkey)),
w as (select question_id, q, ' ' || regexp_replace(q, '[^\p{L}\p{N}_]', ' ', 'g') || ' ' as words from q),
m as (select question_id, full_name, contains(q, low) as whole, case when contains(q, low) then length(low) else length(last) end as size
      from w, l where contains(q, last) and (contains(q, low) or contains(words, ' ' || regexp_replace(last, '[^\p{L}\p{N}_]', ' ', 'g') || ' '))
      qualify row_number() over (partition by question_id order by whole desc, size desc, full_name) <= 3)
select question_id, string_agg(full_name, '|' order by whole desc, size desc, full_name) as entities from m group by 1""",
    "facts_upsert": """with o as (select 2000 as year, lower(c_name) as name, c_nationkey, c_acctbal, c_mktsegment from customer where c_custkey % 10 <> 3),
n as (select 2000 as year, lower(c_name) as name, case when c_custkey % 4 = 0 then c_nationkey + 1 end as c_nationkey, c_acctbal + 1 as c_acctbal from customer where c_custkey % 10 > 1)
select coalesce(o.year, n.year)::int as year, coalesce(o.name, n.name) as name, coalesce(n.c_nationkey, o.c_nationkey) as c_nationkey, round(coalesce(n.c_acctbal, o.c_acctbal), 2) as c_acctbal, c_mktsegment,
       case when n.name is not null then 'new' else 'old' end as last_updated
from o full join n on o.name = n.name""",
    "facts_upsert_conflicts": """select c_custkey, 'c_nationkey' as field, c_nationkey::varchar as old_value, (c_nationkey + 1)::varchar as new_value from customer where c_custkey % 4 = 0
union all select c_custkey, 'c_mktsegment', c_mktsegment, 'NEW' from customer where c_custkey % 5 = 0""",
    "facts_overrides": "select p_partkey, case when p_size > 45 then 'large ' || p_name else p_name end as p_name, p_brand from part",
    "facts_titles": r"""with t as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1] as title from documents)
select doc_id, md5(title) as title_md5, title is not null and doc_id % 3 <> 0 as changed from t""",
    "sources_zip": """with c as (select conv_id, role, (row_number() over (partition by conv_id order by turn, role, length(text)) - 1)::int as pos, length(text) as n from conversations)
select conv_id, pos, role as item, case when pos < 3 then n end::int as score from c where conv_id % 5 > 0
union all select distinct conv_id, null::int, null, null::int from c where conv_id % 5 = 0""",
    "reconcile": """with d as (select doc_id, count(*) as n from documents group by 1), l as (select doc_id, count(*) as n from labels group by 1)
select (select count(*) from documents) as n_documents, (select count(*) from labels) as n_labels, count(*) filter (d.n is null or l.n is null) as n_unmatched,
       (select count(*) from documents) = (select count(*) from labels) and count(*) filter (d.n is null or l.n is null) = 0 as consistent
from d full join l using (doc_id)""",
    "missing_files": "select doc_id, doc_id || '.txt' as file from documents where doc_id not in (select doc_id from labels)",
}

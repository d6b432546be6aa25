"""Queries of the package's own operators, by name, each with the SQL that gives the same rows.

Lines to parse are made from the customer table by rule (plans.fixtures); the SQL states what they say without parsing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridextract.functions import codes, money, names
from gridextract.functions import pages as page_functions
from gridextract.functions.text import dealt, percent, ratio
from gridextract.operators import dedupe, edits, layout, match, meta, pages, quality, reread, rows
from gridextract.plans import extract as plan
from gridextract.plans.fixtures import HEADING, ROSTER, TRUTH, page_text, roster, spread, table, truth
from gridextract.plans.fixtures import lines as noisy_lines
from gridextract.sources import csv_export
from gridextract.sources import roster as roster_source

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def longs(d: DataFrame) -> DataFrame:
    """Whole numbers as long, as the SQL has them."""
    return d.select(*(F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in d.dtypes))


@query(f"select coverage, count(*) as n_rows, cast(sum(cents)/100.0 as double) as charge_total from ({TRUTH}) as t group by coverage")
def flagship_charges_by_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows.line_rows(rows.text_lines(page_text(spark, sf_dir)))
    return d.groupBy("coverage").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("charge").alias("charge_total"))


@query(f"select file_name, cast(page as bigint) as page, concat(last_name, ', ', first_name) as name, cast(family_count as bigint) as family_count, coverage, status, plan as medical_plan, cast(cents/100.0 as double) as charge, cast(0 as bigint) as n_flags from ({TRUTH}) as t")
def row_extract_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows.line_rows(rows.text_lines(page_text(spark, sf_dir)))
    return longs(d.select("file_name", "page", "name", "family_count", "coverage", "status", "medical_plan", "charge", F.size("flags").alias("n_flags")))


@query(f"select file_name, cast(page as bigint) as page, concat(last_name, ', ', first_name) as name, coverage, status, plan as medical_plan, cast(cents/100.0 as double) as charge from ({TRUTH}) as t")
def row_extract_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rows.stream_rows(rows.text_lines(page_text(spark, sf_dir)))
    return longs(d.select("file_name", "page", "name", "coverage", "status", "medical_plan", "charge"))


@query(f"select file_name, cast(row_number() over (partition by file_name order by k) as bigint) as row_index, cast(page as bigint) as page, concat(last_name, ', ', first_name) as name, cast(family_count as bigint) as family_count, coverage, status, plan as medical_plan, cast(cents/100.0 as double) as charge from ({TRUTH}) as t")
def members_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both passes, merged by page and by file."""
    d = plan.extract(page_text(spark, sf_dir))
    return longs(d.select("file_name", "row_index", "page", "name", "family_count", "coverage", "status", "medical_plan", "charge"))


def _read(spark: SparkSession, sf_dir: str, strangers: bool = False) -> DataFrame:
    """What the lines say, as rows of the members table, without parsing. strangers: every tenth row is of someone whom no
    list knows."""
    d = truth(spark, sf_dir)
    name = F.concat("last_name", F.lit(", "), "first_name")
    if strangers:
        odd = F.expr("split_part('OXBOW,UMBRA,THYMUS,JIGZAG,QUOKKA,MYRRH,VORTEX,ZEPHYR,KUDZU', ',', cast(floor((k%90)/10) as int)+1)")
        name = F.when(F.col("k") % 10 == 3, F.concat(odd, F.lit(", PIPPY"))).otherwise(name)
    return d.select("file_name", F.col("k").cast("int").alias("row_index"), name.alias("name"), "family_count", "coverage", "status", F.col("plan").alias("medical_plan"), (F.col("cents") / 100).cast("double").alias("charge"), "page", F.array().cast("array<string>").alias("flags"))


@query(f"select file_name, cast(ord as bigint) as row_index, name, case when found then read else '' end as ocr_name, case when found then cast(cents/100.0 as double) end as charge, case when found then coverage else '' end as coverage, cast(case when found then page else 0 end as bigint) as page, not found as missing from ({ROSTER}) as r")
def roster_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = match.apply_roster(roster(spark, sf_dir), _read(spark, sf_dir, strangers=True))
    return longs(d.select("file_name", "row_index", "name", "ocr_name", "charge", "coverage", "page", match.is_missing(F.col("flags")).alias("missing")))


@query(f"select file_name, cast(ord as bigint) as row_index, read as name from ({ROSTER}) as r where not found")
def roster_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(match.unused_rows(roster(spark, sf_dir), _read(spark, sf_dir, strangers=True)).select("file_name", "row_index", "name"))


@query(f"select file_name, cast(ord as bigint) as row_index, read as name from ({ROSTER}) as r where not found")
def leftover_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, left = plan.reconcile(_read(spark, sf_dir, strangers=True), roster(spark, sf_dir))
    return longs(left.select("file_name", "row_index", "name"))


@query(f"select file_name, concat(cast(count(*) as varchar), case when count(*)=1 then ' member' else ' members' end, ' on the list were not found on this invoice: ', string_agg(name, '; ' order by ord)) as warning from ({ROSTER}) as r where not found group by file_name union all select file_name, concat(cast(count(*) as varchar), case when count(*)=1 then ' OCR row did not match the member list and was ignored: ' else ' OCR rows did not match the member list and were ignored: ' end, string_agg(read, '; ' order by ord)) from ({ROSTER}) as r where not found group by file_name")
def match_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled, left = plan.reconcile(_read(spark, sf_dir, strangers=True), roster(spark, sf_dir))
    return plan.warnings(filled, left)


@query(f"select file_name, k, concat(last_name, ', ', first_name) as name, k as source, case when k%10=3 then concat('QX', substring(last_name, 3), ', XQ') else concat(last_name, ', ', first_name) end as read, cast(cents/100.0 as double) as charge from ({TRUTH}) as t")
def leftover_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth name is read too badly to match; its row is a leftover, which fills the placeholder at a lower bound."""
    d = truth(spark, sf_dir)
    name = F.concat("last_name", F.lit(", "), "first_name")
    known = d.select("file_name", F.col("k").cast("int").alias("ord"), name.alias("name"))
    worn = d.select("file_name", F.col("k").cast("int").alias("row_index"), F.concat(F.lit("QX"), F.substring("last_name", 3, 99), F.lit(", XQ")).alias("worn"))
    read = _read(spark, sf_dir).join(worn, ["file_name", "row_index"]).withColumn("name", F.when(F.col("row_index") % 10 == 3, F.col("worn")).otherwise(F.col("name"))).drop("worn")
    pairs = match.assign(known, read)
    got = match.fill_from_leftover(match.apply_roster(known, read, pairs), match.unused_rows(known, read, pairs))
    return longs(got.select("file_name", F.col("row_index").alias("k"), "name", F.col("source_index").alias("source"), F.col("ocr_name").alias("read"), "charge"))


@query("select o_orderkey, cast(100+(o_orderkey*7919)%7000 as double) as amount from orders")
def money_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", (100 + (F.col("o_orderkey") * 7919) % 7000).alias("v"))
    text, kind = F.format_number("v", 0), F.col("o_orderkey") % 5
    token = (
        F.when(kind == 0, F.concat(F.lit("$"), text, F.lit(".00}"))).when(kind == 1, F.concat(F.lit("$"), F.col("v").cast("string"), F.lit("00")))
        .when(kind == 2, F.concat(F.lit("$"), F.replace(text, F.lit(","), F.lit(".")), F.lit(".00"))).when(kind == 3, F.concat(F.lit("[$"), text, F.lit("00")))
        .otherwise(F.concat(F.lit("$"), F.col("v").cast("string")))
    )
    token = F.when((kind == 3) & (F.col("v") < 1000), F.concat(F.lit("$"), F.col("v").cast("string"), F.lit(".00"))).otherwise(token)
    return d.select("o_orderkey", money.extracted(token).alias("amount"))


@query("select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, concat(cast(60+l_partkey%900 as varchar), case when l_partkey%900=l_suppkey%900 then '' else concat('|', cast(60+l_suppkey%900 as varchar)) end) as amounts from lineitem")
def money_line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = 60 + F.col("l_partkey") % 900, 60 + F.col("l_suppkey") % 900
    line = F.concat(F.lit("CURRENT  $ "), a.cast("string"), F.lit(".00 ~~~ $"), b.cast("string"), F.lit(" .00 NOTHING MORE TO BE SAID ON THIS LINE, NOT EVEN A NUMBER"))
    found = F.transform(money.in_line(line), lambda v: v.cast("long").cast("string"))
    return longs(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(found, "|").alias("amounts")))


@query(f"select k, coverage, case coverage when 'E' then 'Employee Only' when 'ES' then 'Employee and Spouse' when 'ESD' then 'Employee, Spouse and Dependent(s)' when 'ED' then 'Employee and Dependent(s)' else 'Employee and Adult dependent' end as coverage_label, status, case status when 'A' then 'Active' when 'C' then 'Cobra' else 'Terminated' end as status_label, plan from ({TRUTH}) as t")
def code_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes read back from worn tokens."""
    d = truth(spark, sf_dir)
    worn = F.create_map(*(F.lit(x) for x in ("E", "[EE", "ES", "es.", "ESD", "ESB", "ED", "EP]", "EA", "ea")))[F.col("coverage")]
    state = F.when(F.col("status") == "T", "TV").when(F.col("status") == "A", "aa").otherwise("(C)")
    worn_plan = F.when(F.col("plan") == "DHMO", "owmo").otherwise(F.lower("plan"))
    cover, stat = names.coverage(worn), names.status(state)
    return d.select("k", cover.alias("coverage"), codes.coverage_label(cover).alias("coverage_label"), stat.alias("status"), codes.status_label(stat).alias("status_label"), names.plan(worn_plan).alias("plan"))


@query(f"select k, true as person, false as label, concat(last_name, ', ', first_name) as roster_name, false as junk, cast(k%6+1 as bigint) as family, true as masked from ({TRUTH}) as t")
def name_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = truth(spark, sf_dir)
    name = F.concat("last_name", F.lit(", "), "first_name")
    messy = F.concat(F.lit("  "), F.lower("last_name"), F.lit(" ,   "), F.lower("first_name"), F.lit(" "))
    family = F.when(F.col("k") % 2 == 0, F.concat(F.lit("L"), F.col("family_count").cast("string"))).otherwise(F.col("family_count").cast("string"))
    return longs(d.select("k", names.is_name(name).alias("person"), names.is_name(F.concat(F.lit("SUBTOTAL"), name)).alias("label"), names.roster_name(messy).alias("roster_name"), names.junk_name(name).alias("junk"), names.family_count(family).alias("family"), names.subscriber_id(F.lit("xxXx0003")).alias("masked")))


@query("select p_partkey, cast(levenshtein(upper(p_type), upper(p_name)) as bigint) as distance, cast(1.0 - cast(levenshtein(upper(p_type), upper(p_name)) as double) / greatest(length(p_type), length(p_name)) as double) as likeness from part")
def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.upper("p_type"), F.upper("p_name")
    return longs(table(spark, sf_dir, "part").select("p_partkey", F.levenshtein(a, b).alias("distance"), ratio(a, b).alias("likeness")))


META_SQL = f"""select file_name, concat('ACME WORKS ', cast(min(k) as varchar)) as customer_name, cast(100000000+min(k) as varchar) as billing_id, cast(700000+min(k) as varchar) as statement_id,
 '08/01/2026' as invoice_date, 'August 2026' as bill_period, '9/15/26' as due_date, cast(min(k)*1000+0.5 as double) as total_amount_due from ({TRUTH}) as t group by file_name"""


@query(META_SQL)
def header_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields scattered over the pages of a file; later pages repeat some of them with other values."""
    d = truth(spark, sf_dir).groupBy("file_name").agg(F.min("k").alias("k"))
    n = lambda c: c.cast("string")
    one = F.concat(F.lit("ACME WORKS "), n(F.col("k")), F.lit("\nConsolidated Billing ID: "), n(F.col("k") + 100000000), F.lit("\nInvoice Date 08/01/2026"))
    two = F.concat(F.lit("Statement ID: "), n(F.col("k") + 700000), F.lit("  Bill Period: August 2026\nDue Before 9/15/26\nInvoice Date 09/09/2029"))
    three = F.concat(F.lit("Total Charges $5.00 Please pay this Amount: $"), F.format_number(F.col("k") * 1000 + 0.5, 2), F.lit(" Statement ID 999999999"))
    text = d.select("file_name", F.posexplode(F.array(one, two, three)).alias("page", "text"))
    return meta.merged_header(meta.header_fields(text))


PAGES = """select o_orderkey as f, p as page, case when (o_orderkey+p)%7=0 then 'legend' when (o_orderkey*3+p*5)%11=0 then 'full' when (o_orderkey*5+p)%13=0 then 'overflow' else 'other' end as kind from orders, (values (1),(2),(3),(4),(5),(6),(7),(8)) as v(p)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("f"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("page"))
    f, p = F.col("f"), F.col("page")
    kind = F.when((f + p) % 7 == 0, "legend").when((f * 3 + p * 5) % 11 == 0, "full").when((f * 5 + p) % 13 == 0, "overflow").otherwise("other")
    name = F.lit("WEXFORD, ANNABEL 1 $100.00\n")
    text = F.when(kind == "legend", "Medical  Plan Legend").when(kind == "full", F.repeat(name, 9)).when(kind == "overflow", F.concat(name, F.lit("Subtotal for Bill Group 1"))).otherwise(F.lit("Notes"))
    return d.select("f", "page", F.col("f").cast("string").alias("file_name"), text.alias("text"))


@query(f"select cast(f as bigint) as f, cast(page as bigint) as page, kind from ({PAGES}) as x")
def page_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(pages.classified(_pages(spark, sf_dir)).select("f", "page", "kind"))


@query(f"""with x as ({PAGES}), beside as (select *, lag(kind) over (partition by f order by page) as before, lead(kind) over (partition by f order by page) as after from x),
 judged as (select *, kind in ('full', 'overflow') or (kind='other' and (coalesce(before='full', false) or coalesce(after='overflow', false))) as said from beside),
 taken as (select *, said or (kind<>'legend' and page between 3 and 7 and not bool_or(said) over (partition by f)) as taken from judged),
 main as (select *, coalesce(min(case when kind='full' then page end) over (partition by f), min(page) over (partition by f)) as m from taken where taken)
 select cast(f as bigint) as f, cast(page as bigint) as page, case when page=m then 'main' else 'overflow' end as role from main""")
def target_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = pages.classified(_pages(spark, sf_dir)).select("file_name", "page", "kind")
    files = d.groupBy("file_name").agg(F.max("page").alias("page_count"))
    return longs(pages.target_pages(d, files).select(F.col("file_name").cast("long").alias("f"), "page", "role"))


@query("select doc_id, length(regexp_replace(text, '[^A-Za-z]', '', 'g'))<80 as needs_ocr, regexp_matches(text, '(?i)Membership Detail for Group ID|Family Count|Medical current charge') as useful, not regexp_matches(text, '(?i)Membership Detail for Group ID|Family Count|Medical current charge') and not (length(regexp_replace(text, '[^A-Za-z]', '', 'g'))>=120 and len(regexp_extract_all(text, '[A-Za-z]{4,}'))>=8 and regexp_matches(text, '(?i)Consolidated Billing|Payment Summary|About Your Bill|Please pay this Amount|Total Amount Due|Medical Plan Legend')) as try_more from documents")
def ocr_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", page_functions.needs_ocr(t).alias("needs_ocr"), page_functions.looks_useful(t).alias("useful"), page_functions.try_more_orientations(t).alias("try_more"))


@query("select conv_id, turn, case when length(text)%2=0 then 'b' else 'a' end as best, cast(case when length(text)%2=0 then 4 else 3 end as bigint) as score from conversations")
def text_candidate_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.char_length("text") % 2 == 0
    a, b = F.lit("DARNLEY, FAY"), F.when(even, F.lit("$12.50")).otherwise(F.lit("  "))
    best = page_functions.best_text(F.array(a, b))
    return longs(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(best == a, "a").otherwise("b").alias("best"), page_functions.read_score(best).alias("score")))


@query("select o_orderkey, i as band, cast(greatest(0.0, (i*(1.0/n) - case when i=0 then 0 else 0.22*(1.0/n) end)*h) as double) as top, cast(least(h, ((i+1)*(1.0/n) + case when i=n-1 then 0 else 0.22*(1.0/n) end)*h) as double) as bottom from (select o_orderkey, cast(1+o_orderkey%6 as double) as n, cast(800+o_orderkey%500 as double) as h, unnest(range(1+o_orderkey%6)) as i from orders) as x")
def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.posexplode(layout.band_ranges((800 + F.col("o_orderkey") % 500).cast("double"), (1 + F.col("o_orderkey") % 6).cast("int"))).alias("band", "r"))
    return longs(d.select("o_orderkey", "band", "r.top", "r.bottom"))


INK = "select l_orderkey, cast(l_linenumber*10 as int) + v.y as y, case when v.y < 2 + (l_partkey+l_linenumber*3)%8 then 0.5 else 0.001 end as ink from lineitem, (values (0),(1),(2),(3),(4),(5),(6),(7),(8),(9)) as v(y)"
INK_RUNS = f"""on_ as (select l_orderkey, y from ink where ink >= 0.018), gaps as (select *, case when y - (lag(y) over (partition by l_orderkey order by y) + 1) > 3 or lag(y) over (partition by l_orderkey order by y) is null then 1 else 0 end as g from on_),
 runs as (select l_orderkey, run, min(y) as s, max(y)+1 as e from (select *, sum(g) over (partition by l_orderkey order by y) as run from gaps) as q group by l_orderkey, run)"""


def _ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("v"))
    return d.select("l_orderkey", (F.col("l_linenumber") * 10 + F.col("v")).alias("y"), F.when(F.col("v") < 2 + (F.col("l_partkey") + F.col("l_linenumber") * 3) % 8, 0.5).otherwise(0.001).alias("ink"))


@query(f'with ink as ({INK}), {INK_RUNS} select l_orderkey, cast(s as bigint) as "start", cast(e as bigint) as "end" from runs')
def ink_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(layout.ink_runs(_ink(spark, sf_dir), ["l_orderkey"]))


@query(f"""with ink as ({INK}), {INK_RUNS}, mid as (select l_orderkey, (list_sort(list(e-s)))[cast(floor(count(*)/2) as int)+1] as m from runs group by l_orderkey)
 select r.l_orderkey, cast(s as bigint) as "start", cast(e as bigint) as "end" from runs r join mid on r.l_orderkey=mid.l_orderkey where not (e-s < greatest(8.0, m*0.38) or (s > 80*0.97 and e-s < m*0.8))""")
def visual_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = layout.ink_runs(_ink(spark, sf_dir), ["l_orderkey"])
    return longs(layout.visual_rows(runs, runs.select("l_orderkey", F.lit(80.0).alias("table_height")).distinct(), ["l_orderkey"]))


@query("select o_orderkey, string_agg(concat('L', n, ' P', o_custkey, ' S', o_orderkey%97), chr(10) order by n) as text from (select o_orderkey, o_custkey, unnest([1,2,3]) as n from orders) as x group by o_orderkey")
def lines_from_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines of three words for each order, out of order and not quite level."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    word = lambda text, x, dy: F.struct(text.alias("text"), F.lit(x).alias("x0"), (F.col("n") * 40 + dy).cast("double").alias("y0"), F.lit(x + 50).alias("x1"), (F.col("n") * 40 + dy + 12).cast("double").alias("y1"))
    say = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    words = F.array(word(say("S", F.col("o_orderkey") % 97), 300.0, 0), word(say("P", F.col("o_custkey")), 150.0, 3), word(say("L", F.col("n")), 10.0, 1))
    return layout.lines_from_words(d.select("o_orderkey", F.explode(words).alias("w")).select("o_orderkey", "w.*"), ["o_orderkey"])


@query("select c_custkey, case when c_custkey%3=0 then cast(500+c_custkey%100 as double)*2 when c_custkey%3=1 then cast(100+c_custkey%50 as double)*10 else null end as charge from customer")
def merge_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    a = F.when(k % 3 == 0, (500 + k % 100).cast("double") * 2).when(k % 3 == 1, (100 + k % 50).cast("double"))
    b = F.when(k % 3 == 1, a * 10)
    return table(spark, sf_dir, "customer").select("c_custkey", money.merged_charge(a, b).alias("charge"))


@query("select c_custkey, concat('PART', split_part('BERG,LAND,VALE', ',', cast(c_custkey%3 as int)+1), ', ', split_part('SEAN,MARIA,DIANA', ',', cast(c_custkey%3 as int)+1)) as name from customer")
def comma_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names whose comma was lost get it back."""
    pick = lambda xs: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("c_custkey") % 3 + 1).cast("int"))
    line = F.concat(F.lit("PART"), pick(("BERG", "LAND", "VALE")), F.lit(" "), pick(("SEAN", "MARIA", "DIANA")))
    return spread(spark, sf_dir, "customer", "c_custkey").select("c_custkey", names.with_comma(line).alias("name"))


@query("select o_orderkey, case when o_orderkey%4=0 then 'missing' when o_orderkey%4=1 then 'ok' else 'needs-review' end as name_status, case when o_orderkey%3=0 then 'ok' when o_orderkey%3=1 then 'needs-review' else 'missing' end as amount_status, case when o_orderkey%3=0 then cast(750 as double) when o_orderkey%3=1 then cast(9000 as double) end as amount from orders")
def field_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.when(k % 4 == 0, "  ").when(k % 4 == 1, "Barberg,  Alice").when(k % 4 == 2, "Barberg Alice").otherwise("B1")
    amount = F.when(k % 3 == 0, "$750.00").when(k % 3 == 1, "$9,000.00").otherwise(" ")
    d = table(spark, sf_dir, "orders").select("o_orderkey", quality.name_field(raw, F.lit(80.0)).alias("n"), quality.amount_field(amount, F.lit(None).cast("double")).alias("a"))
    return d.select("o_orderkey", F.col("n.status").alias("name_status"), F.col("a.status").alias("amount_status"), F.col("a.value").alias("amount"))


FLAGGED = f"select *, k%17=5 as excluded, k%19=7 as gone, k%23=3 as flagged, file_name like '%7.txt' as bad from ({TRUTH}) as t"


def _flagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d, k = _read(spark, sf_dir), F.col("row_index")
    flags = F.filter(F.array(F.when(k % 19 == 7, match.NOT_FOUND), F.when(k % 23 == 3, "Charge needs review")), lambda x: x.isNotNull())
    d = d.withColumn("excluded", k % 17 == 5).withColumn("flags", flags)
    files = d.select("file_name").distinct().withColumn("errors", F.when(F.col("file_name").endswith("7.txt"), F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>")))
    return d, files


@query(f"select file_name, count(*) filter (where not excluded and not gone) as n_rows, count(*) filter (where not excluded and not gone and (flagged or bad)) as n_issues, cast(coalesce(sum(cents) filter (where not excluded and not gone), 0)/100.0 as double) as charge_total, bool_or(bad) as attention from ({FLAGGED}) as t group by file_name")
def invoice_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.summary(*_flagged(spark, sf_dir))


@query(f"select file_name, k as row_index from ({FLAGGED}) as t where not excluded and not gone and (flagged or bad)")
def issues_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(quality.issues(*_flagged(spark, sf_dir)).select("file_name", "row_index"))


@query(f"""select file_name, cast(n as bigint) as visual, concat('Detected ', n+2, ' visual table rows but only ', n, ' have a readable name — review blank/garbled rows before export.') as first_warning, cast(2 as bigint) as n_warnings from (select file_name, count(*) as n from ({TRUTH}) as t group by file_name) as x""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = truth(spark, sf_dir).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    w = quality.completeness_warnings(F.col("n") + 2, F.col("n"), F.col("n"), F.lit(10.0), F.lit(10.5))
    return longs(d.select("file_name", F.col("n").alias("visual"), F.get(w, F.lit(0)).alias("first_warning"), F.size(w).alias("n_warnings")))


@query(f"""select file_name, k as row_index, concat('"', last_name, ', ', first_name, '",', family_count, ',', coverage, ',', status, ',', plan, ',', cents//100, '.00,ST', substring(file_name, 5, 1), ',', file_name, concat(',"August ', repeat('"', 2), '26', repeat('"', 3))) as line from ({FLAGGED}) as t where not excluded and not gone""")
def export_csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, files = _flagged(spark, sf_dir)
    headers = files.select("file_name", F.concat(F.lit("ST"), F.substring("file_name", 5, 1)).alias("statement_id"), F.lit('August "26"').alias("bill_period"))
    return longs(csv_export.csv_lines(csv_export.export_rows(members, headers)))


@query(f"select k as row_index, case when k%5=0 then 'PPO' else plan end as medical_plan, case when k%7=0 then null when k%5=0 then cast(k%1000+60 as double) else cast(cents/100.0 as double) end as charge, cast(case when k%7=0 then 1 else 0 end as bigint) as n_flags from ({TRUTH}) as t")
def edits_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several edits of one cell: the last one counts; an amount that is none empties the cell."""
    d, k = _read(spark, sf_dir), F.col("row_index")
    edit = lambda when, field, value, seq: F.when(when, F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(seq).alias("seq")))
    made = F.array(edit(k % 5 == 0, "charge", F.lit("1"), 1), edit(k % 5 == 0, "charge", F.concat(F.lit("$"), (k % 1000 + 60).cast("string")), 2), edit(k % 5 == 0, "medical_plan", F.lit("PPO"), 3), edit(k % 7 == 0, "charge", F.lit("none"), 4))
    changes = d.select("file_name", "row_index", F.explode(F.filter(made, lambda e: e.isNotNull())).alias("e")).select("file_name", "row_index", "e.*")
    return longs(edits.apply_edits(d, changes).select("row_index", "medical_plan", "charge", F.size("flags").alias("n_flags")))


@query("select o_custkey, o_orderkey, first_order from (select o_custkey, o_orderkey, min(o_orderkey) over (partition by o_custkey) as first_order, row_number() over (partition by o_custkey order by o_orderkey desc) as n from orders) as x where n=1")
def invoice_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return edits.upsert(d.where("o_orderkey % 2 = 0"), d.where("o_orderkey % 2 = 1"), "o_custkey", "o_orderkey")


@query(f"select file_name, cast(row_number() over (partition by file_name order by late, k) + case when late then (max(case when not late then k end) over (partition by file_name)) - (count(*) filter (where not late) over (partition by file_name)) else k - row_number() over (partition by file_name order by late, k) end as bigint) as row_index, name, late as added from (select file_name, k, concat(last_name, ', ', first_name) as name, k%9=0 as late from ({TRUTH}) as t) as x")
def add_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _read(spark, sf_dir)
    got = edits.add_rows(d.where("row_index % 9 <> 0"), d.where("row_index % 9 = 0").withColumn("name", F.lower("name")))
    return longs(got.select("file_name", "row_index", "name", F.array_contains("flags", match.ADDED).alias("added")))


@query(f"select file_name, cast(row_number() over (partition by file_name order by k) as bigint) as ord, concat(last_name, ', ', first_name) as name from ({TRUTH}) as t")
def roster_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with a Name column (even files) or plain, with repeated lines."""
    d = truth(spark, sf_dir).withColumn("even", F.regexp_extract("file_name", r"(\d+)", 1).cast("int") % 2 == 0)
    name = F.concat("last_name", F.lit(", "), F.lower("first_name"))
    line = F.when(F.col("even"), F.concat(F.lit('x\t"'), name, F.lit('",7'))).otherwise(name)
    text = F.array_join(F.array_sort(F.collect_list(F.struct("k", line.alias("line"))))["line"], "\r\n")
    files = d.groupBy("file_name", "even").agg(text.alias("body")).select("file_name", F.concat(F.when(F.col("even"), "﻿Id,Name,N\n").otherwise(""), "body", F.lit("\n"), "body").alias("text"))
    return longs(roster_source.parse_roster(files))


@query("select distinct name from (select s_name as name from supplier union all select replace(c_name, 'Customer', 'Supplier') from customer) as x")
def roster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")).distinct()
    extra = table(spark, sf_dir, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("name")).distinct()
    return edits.merge_roster(known, extra)


@query(f"select k, name, coverage, charge, n_flags from (select k, concat(last_name, ', ', first_name) as name, coverage, cast(cents/100.0 as double) as charge, cast(1 as bigint) as n_flags from ({TRUTH}) as t) as x")
def fuzzy_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A complete row and one with a letter too many and gaps are one row."""
    d = _read(spark, sf_dir).withColumn("k", F.col("row_index").cast("long")).withColumn("flags", F.array(F.lit("Missing coverage"), F.lit("Charge needs review")))
    one = d.withColumn("pass", F.lit(0)).withColumn("coverage", F.lit(""))
    two = d.withColumn("pass", F.lit(1)).withColumn("name", F.concat("name", F.lit("S"))).withColumn("charge", F.lit(None).cast("double")).withColumn("medical_plan", F.lit(""))
    got = dedupe.dedupe(one.unionByName(two), ["k"], ["pass"])
    return got.select("k", "name", "coverage", "charge", F.size("flags").cast("long").alias("n_flags"))


#: A name of its own for each k, far from all others.
OWN_NAME = "concat('M', upper(translate(substring(md5(concat('a', k)), 1, 12), '0123456789', 'ghijklmnop')), ', ', upper(translate(substring(md5(concat('b', k)), 1, 8), '0123456789', 'ghijklmnop')))"


@query(f"select cast(row_number() over (order by k) as bigint) as row_index, {OWN_NAME} as name, coverage, cast(cents/100.0 as double) as charge from ({TRUTH}) as t")
def merge_one_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file with all rows, each of them twice: without its charge, and far below with a letter too many and without codes."""
    d = truth(spark, sf_dir).withColumn("name", F.expr(OWN_NAME))
    same = d.select("k", "name", "coverage", "status", F.col("plan").alias("medical_plan"), "family_count", (F.col("cents") / 100).alias("charge"), F.array().cast("array<string>").alias("flags"))
    one = same.withColumn("page", F.lit(1)).withColumn("charge", F.lit(None).cast("double"))
    two = same.withColumn("page", F.lit(2)).withColumn("name", F.concat("name", F.lit("S"))).withColumns({c: F.lit("") for c in ("coverage", "status", "medical_plan")}).withColumn("family_count", F.lit(None).cast("int"))
    got = dedupe.dedupe_large(one.unionByName(two).withColumn("file_name", F.lit("all")), ["file_name"], ["page", "k"])
    # the row with a charge is the fuller one, so its name stays; the letter that is too many goes
    return longs(got.select("row_index", F.regexp_replace("name", "S\\z", "").alias("name"), "coverage", "charge"))


@query()
def assign_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and parts of all lines as the pairs of one file, with many equal scores: each part goes to one order at most,
    and each order gets one part at most. Not in SQL, as each choice rests on those before it."""
    d = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_discount").alias("score"), F.max("l_quantity").cast("int").alias("quality"))
    got = match.greedy(d.select(F.lit("all").alias("file_name"), F.col("l_orderkey").alias("ord"), F.col("l_partkey").alias("row_index"), "score", "quality"))
    return longs(got.select("ord", "row_index"))


@query(f"select k, status, cast(case when status='T' then 0 when k%2=0 then 100+k%900 else 1000+k%90 end as double) as charge from ({TRUTH}) as t")
def retro_and_terminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that go on with amounts of other months: the first amount counts there, else the first positive one."""
    d, k = truth(spark, sf_dir), F.col("k")
    one = F.when(k % 2 == 0, F.lit(0.0)).otherwise((1000 + k % 90).cast("double"))
    amounts = F.array(one, (100 + k % 900).cast("double"), F.lit(-70.0), F.lit(12.0))
    return d.select("k", "status", money.current_charge(amounts, F.col("status"), k % 2 == 1).alias("charge"))


@query("select c_custkey, concat(split_part('BARBER,LUTTER,GREGOR', ',', cast(c_custkey%3 as int)+1), ', ', split_part('ALICE,ERIKA,ELISE', ',', cast(c_custkey%3 as int)+1)) as name from customer")
def fused_name_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that were read as one word."""
    token = F.element_at(F.array(F.lit("BARBERALICE"), F.lit("LUTTERERIKA"), F.lit("GREGORELISE")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return spread(spark, sf_dir, "customer", "c_custkey").select("c_custkey", names.unfused(token).alias("name"))


@query("select o_orderkey as f, count(*) as n_pages, cast(sum(p) as bigint) as page_sum from (select distinct o_orderkey, p from (select o_orderkey, 1+o_orderkey%12 as n, unnest([3,4,5,6,o_orderkey%12-2,o_orderkey%12-1,o_orderkey%12]) as p from orders) as x where p between 1 and n) as y group by o_orderkey")
def fallback_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that are read where none looks like a table."""
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("f"), F.explode(pages.usual_pages((1 + F.col("o_orderkey") % 12).cast("int"))).alias("p"))
    return d.groupBy("f").agg(F.count(F.lit(1)).alias("n_pages"), F.sum("p").alias("page_sum"))


@query("select o_orderkey, concat_ws('|', case when o_orderkey%3=0 then 'Missing name' when o_orderkey%3=1 then 'Name needs review' end, case when o_orderkey%4=0 then 'Missing medical current charge' when o_orderkey%4=1 then 'Charge needs review' end, case when o_orderkey%5=0 then 'Missing coverage' end, case when o_orderkey%7=0 then 'Missing status' end, case when o_orderkey%11=0 then 'Missing medical plan' end, case when o_orderkey%13=0 then 'Missing family count' end) as flags from orders")
def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = lambda m: F.when(k % m == 0, "missing").when(k % m == 1, "needs-review").otherwise("ok")
    code = lambda m, x: F.when(k % m == 0, "").otherwise(x)
    found = quality.row_flags(state(3), state(4), code(5, "E"), code(7, "A"), code(11, "PPO"), F.when(k % 13 != 0, 2))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, "|").alias("flags"))


@query(f"select file_name, k as row_index, concat(last_name, ', ', first_name) as name, cast(family_count as varchar) as family_count, coverage, status, plan as medical_plan, concat(cast(cents//100 as varchar), '.00') as charge, concat('ST', substring(file_name, 5, 1)) as statement_id, 'August 2026' as bill_period from ({FLAGGED}) as t where not excluded and not gone")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, files = _flagged(spark, sf_dir)
    headers = files.select("file_name", F.concat(F.lit("ST"), F.substring("file_name", 5, 1)).alias("statement_id"), F.lit("August 2026").alias("bill_period"))
    return longs(csv_export.export_rows(members, headers))


def _strangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders and rows of all members: the list knows everyone, but of every tenth the row is of a stranger."""
    d = truth(spark, sf_dir)
    known = d.select("file_name", F.col("k").cast("int").alias("ord"), F.concat("last_name", F.lit(", "), "first_name").alias("name"))
    return match.apply_roster(known, _read(spark, sf_dir, strangers=True))


@query(f"select file_name, k as row_index, concat(last_name, ', ', first_name) as hint, cast(page as bigint) as page, cast(40*k as double) as y0, cast(40*k+12 as double) as y1 from ({TRUTH}) as t where k%10=3")
def name_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the names of members without a row stand among the words of all tables."""
    words, tables = _word_boxes(spark, sf_dir)
    missing = _strangers(spark, sf_dir).where(match.is_missing(F.col("flags"))).select("file_name", "row_index", "name")
    return longs(reread.name_hints(missing, words, tables).select("file_name", "row_index", "hint", "page", "y0", "y1"))


def _word_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The names of all lines as word boxes, and the tables they lie on."""
    d = truth(spark, sf_dir)
    box = lambda text, x: F.struct(text.alias("text"), F.lit(x).alias("x0"), (F.col("k") * 40).cast("double").alias("y0"), F.lit(x + 80.0).alias("x1"), (F.col("k") * 40 + 12).cast("double").alias("y1"))
    parts = F.array(box(F.lit("$100.00"), 700.0), box(F.col("first_name"), 120.0), box(F.concat("last_name", F.lit(",")), 10.0))
    words = d.select("file_name", "page", F.explode(parts).alias("w")).select("file_name", "page", "w.*")
    return words, d.select("file_name", "page", F.lit(1000.0).alias("width"), F.lit(1e9).alias("height")).distinct()


@query(f"select file_name, k as row_index, concat(last_name, ', ', first_name) as name, coverage, status, plan as medical_plan, cast(cents/100.0 as double) as charge, cast(page as bigint) as page, false as missing from ({TRUTH}) as t")
def second_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members, the placeholders among them filled by a second reading of their lines."""
    words, tables = _word_boxes(spark, sf_dir)
    texts = noisy_lines(spark, sf_dir).select("file_name", F.col("line_no").cast("int").alias("row_index"), "line")

    def read(found: DataFrame) -> DataFrame:
        both = found.join(texts, ["file_name", "row_index"])
        cut = F.regexp_extract("line", r"^(\S+ \S+) (.*)$", 1), F.regexp_extract("line", r"^(\S+ \S+) (.*)$", 2)
        return both.select("file_name", "row_index", "name", "page", cut[0].alias("name_text"), cut[1].alias("rest_text"))

    got = reread.second_look(_strangers(spark, sf_dir), words, tables, read)
    return longs(got.select("file_name", "row_index", "name", "coverage", "status", "medical_plan", "charge", "page", match.is_missing(F.col("flags")).alias("missing")))


@query("select distinct upper(s_name) as name from supplier where s_suppkey%5<>1")
def roster_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list with names taken off."""
    d = table(spark, sf_dir, "supplier")
    known = d.select(F.upper("s_name").alias("name")).distinct()
    return edits.remove_from_roster(known, d.where("s_suppkey % 5 = 1").select(F.upper("s_name").alias("name")))


#: What becomes of the files of plans.fixtures in three uploads, by their number n:
#: n % 6 = 0 comes once; 1 is emptied, and empty again; 2 comes again as it was, then with its first page only; 3 cannot be
#: read, then comes back as it was; 4 cannot be read at first, then is there with its first page; 5 cannot be read in the end.
STREAMED = f"""
select *, cast(k as bigint) // 90 as n, case when cast(k as bigint) // 90 % 6 in (0, 3) then true when cast(k as bigint) // 90 % 6 in (2, 4) then page = 1 else false end as stays from ({TRUTH}) as t
"""


def _streamed(spark: SparkSession, sf_dir: str, **options) -> str:
    """The folder of the stream after the three uploads."""
    from gridextract.sources.shared import shared_folder
    from gridextract.streaming.ingest import arrivals_of, ingest

    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    texts = page_text(spark, sf_dir).withColumn("error", F.lit(None).cast("string"))
    kind = F.regexp_extract("file_name", r"(\d+)", 1).cast("int") % 6
    failed = texts.select("file_name", F.lit(0).alias("page"), F.lit(None).cast("string").alias("text"), F.concat(F.lit("Failed to parse: "), "file_name").alias("error")).distinct()
    emptied = texts.where("page = 1").withColumn("text", F.lit(HEADING))
    first_page = texts.where("page = 1")
    uploads = (
        texts.where(kind != 4).unionByName(failed.where(kind == 4)),
        emptied.where(kind == 1).unionByName(texts.where(kind == 2)).unionByName(failed.where(kind == 3)).unionByName(first_page.where(kind == 4)),
        emptied.where(kind == 1).unionByName(first_page.where(kind == 2)).unionByName(texts.where(kind == 3)).unionByName(failed.where(kind == 5)),
    )
    for number, upload in enumerate(uploads):
        arrivals_of(upload, number).write.mode("append").parquet(f"{at}/in")
        ingest(spark, f"{at}/in", f"{at}/out", f"{at}/state", **options).awaitTermination()
    return f"{at}/out"


@query(f"select file_name, cast(0 as bigint) as first, cast(row_number() over (partition by file_name order by k) as bigint) as row_index, concat(last_name, ', ', first_name) as name, cast(cents/100.0 as double) as charge from ({STREAMED}) as s where stays")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of all files as they stand after uploads that repeat, empty, replace, lose and bring back files."""
    from gridextract.streaming.ingest import current

    return longs(current(spark, _streamed(spark, sf_dir)).select("file_name", "first", "row_index", "name", "charge"))


@query(f"select file_name, cast(case n % 6 when 0 then 1 when 3 then 3 else 2 end as bigint) as version, case when n % 6 = 5 then 'failed' else 'new' end as status, case when n % 6 = 5 then concat('Failed to parse: ', file_name) end as error, cast(case n % 6 when 0 then 0 when 4 then 1 else 2 end as bigint) as arrival, cast(count(*) filter (where stays) as bigint) as n_rows from ({STREAMED}) as s group by file_name, n")
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files after the same uploads: how often each has changed, whether it could be read, and its lines of people."""
    from gridextract.streaming.ingest import files

    people = lambda pages: rows.text_lines(pages).where(F.col("line").contains("XXX-XX-"))
    return longs(files(spark, _streamed(spark, sf_dir, read=people)).select("file_name", "version", "status", "error", "arrival", "n_rows"))


MEMBERS = f"select file_name, cast(row_number() over (partition by file_name order by k) as bigint) as row_index, concat(last_name, ', ', first_name) as name, cast(family_count as bigint) as family_count, coverage, status, plan as medical_plan, cast(cents/100.0 as double) as charge from ({TRUTH}) as t"


def _pages_of(lines: DataFrame) -> DataFrame:
    """Pages from file_name, page, line_no, line, under the heading."""
    d = dealt(lines, "file_name").groupBy("file_name", "page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("line_no", "line")))["line"], "\n").alias("text"))
    return d.select("file_name", "page", F.concat(F.lit(HEADING + "\n"), "text", F.lit("\nSubtotal $1.00")).alias("text"))


@query(MEMBERS)
def row_extract_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose fields run over two lines: only the pass over the stream of tokens sees them whole."""
    d = noisy_lines(spark, sf_dir)
    got = dedupe.members_of(rows.page_rows(_pages_of(d.withColumn("line", F.regexp_replace("line", r" (XXX-XX-\d+) ", " $1\n")))))
    return longs(got.select("file_name", "row_index", "name", "family_count", "coverage", "status", "medical_plan", "charge"))


@query(MEMBERS)
def row_extract_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with lines of other months after a row, subtotals, and rows that are printed twice, the second time with a
    letter too many and without an amount."""
    d, k = noisy_lines(spark, sf_dir), F.col("line_no")
    again = F.regexp_replace("line", r"^(\S+ \S+) (\d) .*$", "$1S $2 N XXX-XX-0000 E")
    more = F.array(
        F.struct(F.lit(0).alias("n"), F.col("line").alias("line")), F.struct(F.lit(1).alias("n"), F.when(k % 4 == 1, "07/2026 MEDICAL $-1,072.00").alias("line")),
        F.struct(F.lit(2).alias("n"), F.when(k % 5 == 2, again).alias("line")), F.struct(F.lit(3).alias("n"), F.when(k % 10 == 9, "Subtotal for Bill Group $12,345.00").alias("line")))
    each = d.select("file_name", "page", "line_no", F.explode(F.filter(more, lambda x: x["line"].isNotNull())).alias("x"))
    text = _pages_of(each.select("file_name", "page", F.struct("line_no", "x.n").alias("line_no"), "x.line"))
    got = dedupe.members_of(rows.page_rows(text))
    return longs(got.select("file_name", "row_index", "name", "family_count", "coverage", "status", "medical_plan", "charge"))


@query("select o_orderkey, case when o_orderkey%2=0 then concat('BARBERG $', o_custkey, '.00', chr(10), 'LANDER $', o_orderkey%97, '.50') else concat('BARBERG $', o_custkey, '.00', repeat(concat(chr(10), '1 2 3'), 7)) end as text from orders")
def zip_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns read apart: of about equal length, and one much longer than the other."""
    d, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = lambda c, cents: F.concat(F.lit("$"), c.cast("string"), F.lit(cents))
    left = F.when(k % 2 == 0, "BARBERG\n\n  LANDER ").otherwise("BARBERG" + "\n1 2 3" * 7)
    right = F.when(k % 2 == 0, F.concat(price(F.col("o_custkey"), ".00"), F.lit("\nab\n"), price(k % 97, ".50"))).otherwise(price(F.col("o_custkey"), ".00"))
    return d.select("o_orderkey", layout.zip_columns(left, right).alias("text"))


@query(f"select file_name, cast(row_number() over (partition by file_name order by page, k) as bigint) as row_index, concat(last_name, ', ', first_name) as name, case when k%2=0 then cast(750 as double) end as charge, '' as coverage, false as excluded, cast(0 as bigint) as n_flags from ({TRUTH}) as t")
def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an older form, with evidence of fields in place of plain values."""
    d = truth(spark, sf_dir)
    raw = F.concat(F.initcap("last_name"), F.lit(",  "), F.lower("first_name"))
    old = d.select("file_name", "page", F.concat(F.lpad(F.col("k").cast("string"), 9, "0"), F.lit(" old")).alias("name"), quality.name_field(raw, F.lit(None).cast("double")).alias("name_field"), quality.amount_field(F.when(F.col("k") % 2 == 0, "$750.00").otherwise(""), F.lit(90.0)).alias("amount_field"))
    return longs(quality.hydrated(old).select("file_name", "row_index", "name", "charge", "coverage", "excluded", F.size("flags").alias("n_flags")))


@query(f"select file_name, count(*) as n_rows from ({ROSTER}) as r where not found group by file_name")
def leftover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.with_leftovers(match.unused_rows(roster(spark, sf_dir), _read(spark, sf_dir, strangers=True)))


@query("select o_orderkey, case o_orderkey%4 when 0 then 'The scanned pages could not be decoded.' when 1 then concat('Could not read this scan (Page ', o_orderkey, ' OCR failed: no). Reload and try again.') else 'No membership rows found.' end as error from orders")
def file_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    failed = F.concat(F.lit("Page "), k.cast("string"), F.lit(" OCR failed: no"))
    warnings = F.when(k % 4 == 0, F.array(failed, F.lit("Page 2 rendered blank"))).when(k % 4 == 1, F.array(F.lit("other"), failed, F.lit("Page 9 OCR failed: late"))).when(k % 4 == 2, F.array(F.lit("other"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select("o_orderkey", quality.file_error(warnings).alias("error"))


@query(f"select file_name, case when floor(k/90)%2=0 then 'No membership rows found.' else 'bad scan' end as reason, cast(3 as bigint) as n_warnings from (select file_name, min(k) as k from ({TRUTH}) as t group by file_name) as f where floor(k/90)%3<>0")
def unread_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third file has rows; of the others some have an error of their own."""
    files = truth(spark, sf_dir).groupBy("file_name").agg(F.floor(F.min("k") / 90).alias("n"))
    files = files.withColumn("errors", F.when(F.col("n") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("bad scan")))).withColumn("warnings", F.array(*(F.lit(str(i)) for i in range(5))))
    read = files.where("n % 3 = 0").select("file_name", F.lit("BARBERG, ALICE").alias("name"))
    return longs(quality.unread_files(files, read).select("file_name", "reason", F.size("warnings").alias("n_warnings")))


@query("select c_custkey, case when c_custkey%3=0 then 'ZZZ' else 'HMO PLUS' end as first_option, cast(case when c_custkey%3=0 then 30 else 29 end as bigint) as n_options from customer")
def plan_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    options = codes.plan_options(F.when(k % 3 == 0, "ZZZ").when(k % 3 == 1, "PPO").otherwise(""))
    return longs(table(spark, sf_dir, "customer").select("c_custkey", F.get(options, F.lit(0)).alias("first_option"), F.size(options).alias("n_options")))


@query("select p_partkey, p_partkey%7=0 or p_partkey%11=0 or p_partkey%13=0 as label from part")
def member_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column labels, totals and page numbers where a name should be."""
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, F.concat(F.lit(" Subtotal "), k.cast("string"))).when(k % 11 == 0, "family count").when(k % 13 == 0, F.concat(F.lit("Page "), k.cast("string"))).otherwise(F.concat(F.lit("Pat "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", names.non_member_label(name).alias("label"))


@query(f"select file_name, name, row_index, added from (select file_name, concat(last_name, ', ', first_name) as name, k as row_index, false as added from ({TRUTH}) as t union all select file_name, 'MOSS, KIM', max(k)+1, true from ({TRUTH}) as t group by file_name) as x")
def blank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed name that is new, one that is there already, and one that is no name, for each file."""
    d = _read(spark, sf_dir)
    typed = d.groupBy("file_name").agg(F.min("name").alias("old")).select("file_name", F.explode(F.array(F.lit(" moss,  kim"), F.lower("old"), F.lit("nobody"))).alias("name"))
    return longs(edits.add_blank_rows(d, typed).select("file_name", "name", "row_index", F.array_contains("flags", match.ADDED).alias("added")))


@query(f"select file_name, max(k)+1 as next_index from ({TRUTH}) as t group by file_name")
def next_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longs(edits.next_index(_read(spark, sf_dir)))


LISTED = f"select distinct concat(last_name, ', ', first_name) as name from ({TRUTH}) as t"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth(spark, sf_dir).select(F.concat("last_name", F.lit(", "), "first_name").alias("name")).distinct()


@query(f"{LISTED} union select concat('NEW', translate(cast(s_suppkey as varchar), '0123456789', 'ABCDEFGHIJ'), ', PAT') from supplier")
def roster_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed names: new ones in small letters, ones that are there, and ones without a comma."""
    listed = _listed(spark, sf_dir)
    new = table(spark, sf_dir, "supplier").select(F.concat(F.lit("new"), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij"), F.lit(",  pat")).alias("name"))
    typed = new.unionByName(listed.select(F.lower("name").alias("name"))).unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("no comma "), "s_name").alias("name")))
    return edits.add_to_roster(listed, typed)


@query(f"select case when name like 'BAR%' then concat(name, 'X') else name end as name from ({LISTED}) as t")
def roster_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that change, one that would take the place of another, and a change that leads to no name."""
    listed = _listed(spark, sf_dir)
    first = F.col("name").startswith("BAR")
    to = F.when(first, F.concat(F.lower("name"), F.lit("x"))).when(F.col("name").startswith("CEL"), "nobody")
    changes = listed.select("name", to.alias("new_name")).where("new_name is not null")
    taken = listed.agg(F.max("name").alias("new_name")).join(listed.where(F.col("name").startswith("DUN")).agg(F.min("name").alias("name")))
    return edits.rename_in_roster(listed, changes.unionByName(taken.select("name", "new_name")))


@query("select o_orderkey, string_agg(concat('L', n, ' P', o_custkey, ' S', o_orderkey%97), chr(10) order by n) as text from (select o_orderkey, o_custkey, unnest([1,2,3]) as n from orders) as x group by o_orderkey")
def lines_from_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded text, whose heights count from the foot of a page, out of order, with blank items."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("n"))
    item = lambda text, x, dy: F.struct(text.alias("text"), F.lit(x).alias("x"), (700 - F.col("n") * 20 + dy).cast("double").alias("y"), F.lit(9.0).alias("h"))
    say = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    items = F.array(item(say("S", F.col("o_orderkey") % 97), 300.0, 0), item(F.lit("  "), 5.0, 0), item(say("P", F.col("o_custkey")), 150.0, 2), item(say("L", F.col("n")), 10.0, 1))
    return layout.lines_from_items(d.select("o_orderkey", F.explode(items).alias("w")).select("o_orderkey", "w.*"), ["o_orderkey"])


@query("""select o_orderkey, string_agg(concat('B', i), chr(10) order by i) filter (where i<>1) as text, cast(count(*) as bigint) as n_words, max(top)+5 as lowest from (select o_orderkey, i, greatest(0.0, (i*(cast(1.0 as double)/n) - case when i=0 then 0.0 else cast(0.22 as double)*(cast(1.0 as double)/n) end)*h) as top
 from (select o_orderkey, cast(300+o_orderkey%500 as double) as h, case when 300+o_orderkey%500 < 1000*0.55 then 3 else 6 end as n, unnest(range(case when 300+o_orderkey%500 < 1000*0.55 then 3 else 6 end)) as i from orders) as x) as y group by o_orderkey""")
def banded_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables read slice by slice by a reader that finds a word in each, and no text in the second one."""
    tables = table(spark, sf_dir, "orders").select("o_orderkey", F.lit(1000.0).alias("width"), (300 + F.col("o_orderkey") % 500).cast("double").alias("height"))
    box = lambda text: F.struct(text.alias("text"), F.lit(1.0).alias("x0"), F.lit(5.0).alias("y0"), F.lit(9.0).alias("x1"), F.lit(15.0).alias("y1"))

    def read(bands: DataFrame) -> DataFrame:
        said = F.concat(F.lit("B"), F.col("band").cast("string"))
        return bands.withColumn("text", F.when(F.col("band") == 1, " ").otherwise(said)).withColumn("words", F.array(box(said), box(F.lit("  "))))

    got = layout.banded_scan(tables, ["o_orderkey"], read)
    return longs(got.select("o_orderkey", "text", F.size("words").alias("n_words"), F.array_max(F.col("words")["y0"]).alias("lowest")))


@query("""with p as (select o_orderkey, cast(800+o_orderkey%500 as double) as w, cast(600+o_orderkey%300 as double) as h, cast(20+o_orderkey%11 as double) as rh from orders),
 t as (select *, case when o_orderkey%2=0 then w*cast(0.008 as double) else 0 end as tx, case when o_orderkey%2=0 then h*cast(0.08 as double) else h*cast(0.03 as double) end as ty, case when o_orderkey%2=0 then w*cast(0.984 as double) else w end as tw, case when o_orderkey%2=0 then h*cast(0.905 as double) else h*cast(0.955 as double) end as th from p),
 r as (select *, greatest(ty, ty+10-rh*cast(0.18 as double)) as ry, least(ty+th, ty+10+rh+rh*cast(0.18 as double)) as rb from t)
 select o_orderkey, round(tx+tw*cast(0.25 as double), 6) as codes_x, round(tw*(cast(0.73 as double)-cast(0.54 as double)), 6) as amount_w, round(ry, 6) as row_y, round(rb-ry, 6) as row_h, round(greatest(0.0, cast(100 as double)-greatest(rh, 12)*cast(0.45 as double)), 6) as strip_y, o_orderkey%20<18 as near from r""")
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of tables, columns, padded rows and strips, and which of them overlap."""
    k = F.col("o_orderkey")
    d = table(spark, sf_dir, "orders").select("o_orderkey", (800 + k % 500).cast("double").alias("w"), (600 + k % 300).cast("double").alias("h"), (20 + k % 11).cast("double").alias("rh"))
    d = d.withColumn("t", layout.table_rect(F.col("w"), F.col("h"), F.when(k % 2 == 0, "main").otherwise("overflow")))
    d = d.withColumn("r", layout.padded(layout.rect(F.col("t.x"), F.col("t.y") + 10, F.col("t.w"), F.col("rh")), F.col("t"))).withColumn("s", layout.strip_rect(F.lit(100.0), F.lit(100.0) + F.col("rh"), F.col("w"), F.col("h")))
    near = layout.overlap(F.lit(0.0), F.lit(10.0), (k % 20).cast("double"), (k % 20 + 5).cast("double"))
    six = lambda c: F.round(c, 6)
    return d.select("o_orderkey", six(layout.column_rect(F.col("t"), "codes")["x"]).alias("codes_x"), six(layout.column_rect(F.col("t"), "amount")["w"]).alias("amount_w"), six(F.col("r.y")).alias("row_y"), six(F.col("r.h")).alias("row_h"), six(F.col("s.y")).alias("strip_y"), near.alias("near"))


@query("select o_orderkey, cast(y as bigint) as y, cast(case when y<=o_orderkey%3 then 0.5 else 0.0 end as double) as ink from orders, (values (0),(1),(2),(3)) as v(y)")
def ink_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four pixels a line: two dark ones on the first lines, else light ones."""
    line = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("i")
    d = table(spark, sf_dir, "orders").select("o_orderkey", line).select("o_orderkey", (F.col("i") % 4).alias("x"), F.floor(F.col("i") / 4).alias("y"))
    dark = (F.col("y") <= F.col("o_orderkey") % 3) & (F.col("x") < 2)
    shade = lambda c, light, ink: F.when(dark, ink).otherwise(light).alias(c)
    return longs(layout.ink_profile(d.select("o_orderkey", "x", "y", shade("r", 255, 250), shade("g", 210, 180), shade("b", 210, 190)), ["o_orderkey"]))


@query(f"""with ink as ({INK}), {INK_RUNS} select l_orderkey, cast(s as bigint) as "start", round(cast(100 as double)+greatest(0.0, s-(e-s)*cast(0.18 as double)), 6) as y, round(least(80.0, s+(e-s)+(e-s)*cast(0.18 as double))-greatest(0.0, s-(e-s)*cast(0.18 as double)), 6) as h from runs""")
def row_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of ink as boxes on their page."""
    runs = layout.ink_runs(_ink(spark, sf_dir), ["l_orderkey"])
    tables = runs.select("l_orderkey", layout.rect(F.lit(7.0), F.lit(100.0), F.lit(500.0), F.lit(80.0)).alias("table")).distinct()
    return longs(layout.row_rects(runs, tables, ["l_orderkey"]).select("l_orderkey", "start", F.round("row.y", 6).alias("y"), F.round("row.h", 6).alias("h")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship_charges_by_coverage(spark, sf_dir)


@query(f"""
with base as (select *, cast(k as bigint) // 90 as n from ({TRUTH}) as t),
kept as (select * from base where n % 3 <> 1 or page = 1),
most as (select file_name, n, max(k) + 1 as k from kept group by file_name, n)
select file_name, k as row_index, concat(last_name, ', ', first_name) as name, cast(case when k % 7 = 0 and n % 3 <> 1 then 1 else cents / 100.0 end as double) as charge, case when k % 5 = 0 then 'T' else status end as status, k % 11 = 0 as excluded, 2000000000 + n as first from kept
union all
select m.file_name, m.k, 'MOSS, KIM', null, '', m.k % 11 = 0 and exists (select 1 from base b where b.k = m.k and b.file_name = m.file_name), 2000000000 + m.n from most m""")
def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffled log of the uploads, edits, added and excluded rows of all files. All go once; every third file is uploaded
    again with its first page only, which undoes its earlier edits."""
    d = _read(spark, sf_dir).withColumn("excluded", F.lit(False))
    uploads = d.withColumn("upload", F.lit(1)).unionByName(d.where("page = 1").withColumn("upload", F.lit(2)))
    k, n = F.col("row_index").cast("long"), F.floor(F.col("row_index") / 90)

    def entries(band: int, kind: str, at, where, upload: int | None = None, field: str | None = None, value: str | None = None) -> DataFrame:
        row = F.col("row_index") if kind == "edit" else F.lit(None).cast("int")
        return d.where(where).select((F.lit(band * 1_000_000_000) + at).alias("seq"), F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("file_name") if kind == "clear" else F.col("file_name"), F.lit(upload).cast("int").alias("upload"), row.alias("row_index"), F.lit(field).cast("string").alias("field"), F.lit(value).cast("string").alias("value")).distinct()

    every = F.lit(True)
    log = entries(0, "upsert", n, every, upload=2)
    for more in (
        entries(1, "clear", F.lit(0), every), entries(2, "upsert", n, every, upload=1), entries(3, "edit", k, k % 7 == 0, field="charge", value="1.00"), entries(4, "upsert", n, n % 3 == 1, upload=2),
        entries(5, "edit", k, k % 5 == 0, field="status", value="T"), entries(6, "add", n, every, value="moss,  kim"), entries(7, "edit", k, k % 11 == 0, field="excluded", value="true"),
    ):
        log = log.unionByName(more)
    got = edits.replay(log.repartition(F.xxhash64("seq")), uploads)
    return longs(got.select("file_name", "row_index", "name", "charge", "status", "excluded", "first"))


@query(f"""
with r as (select * from ({ROSTER}) as r),
added as (select file_name, k, read, row_number() over (partition by file_name order by k) + (select max(k) from r b where b.found and b.file_name = a.file_name) as place from r a where k % 20 = 3)
select 'members' as part, file_name, k as row_index, read as text from r where found
union all select 'members', file_name, place, read from added
union all select 'leftovers', file_name, k, read from r where k % 20 = 13
union all select 'warnings', file_name, null, concat(cast(count(*) as varchar), case when count(*) = 1 then ' OCR row did not match the member list and was ignored: ' else ' OCR rows did not match the member list and were ignored: ' end, string_agg(read, '; ' order by k)) from r where k % 20 = 13 group by file_name
union all select distinct 'roster', '', cast(null as bigint), read from r where k % 20 <> 13""")
def move_leftover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the leftover rows are taken among the members: members, leftovers, warnings and list as one change."""
    from gridextract.sources import versions
    from gridextract.sources.shared import shared_folder

    at = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    d = _read(spark, sf_dir, strangers=True)
    own, left = d.where("row_index % 10 <> 3"), d.where("row_index % 10 = 3")
    before = {"members": own.withColumn("ocr_name", F.col("name")), "leftovers": left, "warnings": quality.ignored_warning(left), "roster": own.select("name").distinct()}
    n = versions.commit(spark, at, before)
    versions.commit(spark, at, edits.move_leftovers(versions.read(spark, at), left.where("row_index % 20 = 3").select("file_name", "row_index", "name")), based_on=n)
    t, null = versions.read(spark, at), F.lit(None).cast("long")
    rows_ = [t[p].select(F.lit(p).alias("part"), "file_name", F.col("row_index").cast("long"), F.col("name").alias("text")) for p in ("members", "leftovers")]
    rows_.append(t["warnings"].select(F.lit("warnings").alias("part"), "file_name", null.alias("row_index"), F.col("warning").alias("text")))
    rows_.append(t["roster"].select(F.lit("roster").alias("part"), F.lit("").alias("file_name"), null.alias("row_index"), F.col("name").alias("text")))
    return rows_[0].union(rows_[1]).union(rows_[2]).union(rows_[3])


_EXPORTED = """concat('"', name, '",', family_count, ',', coverage, ',', status, ',', plan, ',', cents//100, '.00,ST1,', file_name, ',August 2026')"""


@query(f"""
select octet_length(encode(whole)) as n_bytes, sha256(whole) as sha256 from (
  select concat(chr(65279), '{','.join(csv_export.HEADER)}', string_agg(chr(10) || line, '' order by file_name, k)) as whole from (
    select file_name, k, {_EXPORTED} as line from (select *, concat(last_name, ', ', first_name) as name from ({TRUTH}) as t) as t) as l) as w""")
def export_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the export of all files as one CSV file."""
    from gridextract.sources.shared import shared_folder

    at = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}.csv"
    members = _read(spark, sf_dir).withColumn("excluded", F.lit(False))
    headers = members.select("file_name", F.lit("ST1").alias("statement_id"), F.lit("August 2026").alias("bill_period")).distinct()
    csv_export.write_csv(csv_export.export_rows(members, headers), at)
    return spark.read.format("binaryFile").load(at).select(F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query(f"""
with r as (select * from ({ROSTER}) as r),
moved as (select *, row_number() over (partition by file_name order by k) as nth from r where not found and k % 20 = 3),
most as (select file_name, max(k) as k from r group by file_name)
select file_name, k as row_index, concat('"', {"case when k%9=4 then concat(split_part(read, ', ', 1), ', ', substring(split_part(read, ', ', 2), 1, 3)) else read end"}, '",', family_count, ',', coverage, ',', status, ',', plan, ',', case when k % 13 = 1 then '5.50' else concat(cents//100, '.00') end, ',77', cast(k as bigint) // 90 + 700000, ',', file_name, ',August 2026') as line from r where found and k % 17 <> 5
union all
select file_name, k, concat('"', name, '",,,,,5.50,77', cast(k as bigint) // 90 + 700000, ',', file_name, ',August 2026') from r where not found and k % 13 = 1 and k % 17 <> 5
union all
select m.file_name, t.k + m.nth, concat('"', m.read, '",', m.family_count, ',', m.coverage, ',', m.status, ',', m.plan, ',', m.cents//100, '.00,77', cast(m.k as bigint) // 90 + 700000, ',', m.file_name, ',August 2026') from moved m join most t on t.file_name = m.file_name""")
def whole_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pages to export lines: rows read and merged, matched to the list, the leftovers that someone picks taken among
    the members, cells edited and rows excluded, the headers read from the first pages. A member who was not found and gets
    an amount by hand is exported, too."""
    stranger = F.concat(F.expr("split_part('OXBOW,UMBRA,THYMUS,JIGZAG,QUOKKA,MYRRH,VORTEX,ZEPHYR,KUDZU', ',', cast(floor((line_no%90)/10) as int)+1)"), F.lit(", PIPPY"))
    worn = noisy_lines(spark, sf_dir).withColumn("line", F.when(F.col("line_no") % 10 == 3, F.regexp_replace("line", r"^\S+ \S+", stranger)).otherwise(F.col("line")))
    n = F.regexp_extract("file_name", r"(\d+)", 1).cast("long") + 700000
    head = F.concat(F.lit("Statement ID: 77"), n.cast("string"), F.lit("\nBill Period: August 2026\n"))
    text = _pages_of(worn).withColumn("text", F.when(F.col("page") == 1, F.concat(head, "text")).otherwise(F.col("text")))
    known = roster(spark, sf_dir)
    filled, left = plan.reconcile(plan.extract(text), known)
    tables = {"members": filled.drop("source_index"), "leftovers": left, "warnings": plan.warnings(filled, left), "roster": known.select("name").distinct()}
    picked = left.join(worn.where("line_no % 20 = 3").select("file_name", F.regexp_extract("line", r"^\S+ \S+", 0).alias("name")), ["file_name", "name"], "left_semi").select("file_name", "row_index", "name")
    members = edits.move_leftovers(tables, picked)["members"].withColumn("excluded", F.lit(False))
    k = known.select("file_name", F.col("ord").alias("row_index"))
    changes = k.where("row_index % 13 = 1").select("file_name", "row_index", F.lit("charge").alias("field"), F.lit("$5.50").alias("value"), F.lit(1).alias("seq"))
    changes = changes.union(k.where("row_index % 17 = 5").select("file_name", "row_index", F.lit("excluded"), F.lit("true"), F.lit(2)))
    lines_ = csv_export.csv_lines(csv_export.export_rows(edits.apply_edits(members, changes), plan.headers(text)))
    return longs(lines_)


@query(f"select file_name, 'Page 1 looks like Membership Detail but no subscriber rows were read.' as warning from ({TRUTH}) as t where cast(k as bigint) // 90 % 3 = 2 group by file_name")
def page_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main page of every third file has notes in place of its rows."""
    note = F.concat(F.lit(HEADING), F.repeat(F.lit("\nNo activity in this month"), 12))
    void = (F.regexp_extract("file_name", r"(\d+)", 1).cast("int") % 3 == 2) & (F.col("page") == 1)
    return plan.page_warnings(page_text(spark, sf_dir).withColumn("text", F.when(void, note).otherwise(F.col("text"))))


@query("""
select c_custkey, concat(case when c_acctbal < 0 then '-$' else '$' end, format('{:,.2f}', abs(c_acctbal))) as money, case when c_custkey % 30 between 3 and 23 then c_custkey % 30 - 3 end as family,
  c_custkey % 5 < 3 as is_list, c_custkey % 10 < 4 as blank, concat(case when c_custkey % 3 = 0 then 0 else cast(round(100 * (c_custkey % 10) / (1.0 * (c_custkey % 3))) as int) end, '%') as share
from customer""")
def cells_of_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as they are shown, typed family counts, file names of lists, blank pages and shares in per cent."""
    k = F.col("c_custkey")
    ending = F.get(F.array(*(F.lit(x) for x in (".csv", ".TXT", ".Tsv", ".pdf", ".csv.zip"))), (k % 5).cast("int"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", money.formatted(F.col("c_acctbal")).alias("money"), edits.family_input(F.concat(F.lit(" "), (k % 30 - 3).cast("string"))).cast("long").alias("family"),
        roster_source.is_roster_file(F.concat(F.lit("list-"), k.cast("string"), ending)).alias("is_list"), page_functions.is_blank((k % 10) / 1000).alias("blank"), percent(k % 10, k % 3).alias("share"))

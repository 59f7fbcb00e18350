"""Registered queries: the operators over the star-schema tables and a tree made of them, with their SQL.

The tree: regions, in them nations, customers and files named after orders, all on one drive. Limits are
those of the searches themselves (pages, top lists).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import names as N
from lodestone.functions import text as X
from lodestone.operators import catalogue, hierarchy, near, search, substring
from lodestone.operators.ordered import with_previous
from lodestone.sources import files, tables
from lodestone.sources.tables import describe_snapshot, first_of_each, load_snapshot, new_folder, save_snapshot
from lodestone.streaming import changes, placement

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
JUNK, USER = ("asia", "nation_7"), ("europe", "nation_3")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def registered(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def tree(spark: SparkSession, d: str) -> DataFrame:
    """SCAN records of the tree."""
    rows = [
        read(spark, d, "region").selectExpr("1L + r_regionkey as file_ref", "0L as parent_ref", "r_name as name", "true as is_dir"),
        read(spark, d, "nation").selectExpr("100L + n_nationkey", "1L + n_regionkey", "n_name", "true"),
        read(spark, d, "customer").selectExpr("1000L + c_custkey", "100L + c_nationkey", "c_name", "true"),
        read(spark, d, "orders").selectExpr("1000000L + o_orderkey", "1000L + o_custkey", "concat('order_', o_orderkey, '.', lower(o_orderstatus), '_x')", "false"),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out.select(F.lit("C").alias("drive"), "file_ref", "parent_ref", "name", "is_dir")


def placed(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.with_ancestry(tree(spark, d), junk_dirs=JUNK, user_dirs=USER)


#: Snapshots of trees that this application has built: (application, the tables' files) to path.
_SNAPSHOTS: dict[tuple[str, str], str] = {}


def indexed(spark: SparkSession, d: str) -> DataFrame:
    """The tree's entries from a snapshot, built by the first query that searches these very files and read by all others, in the order of extension and name."""
    inputs = [f"{d}/{table}.parquet" for table in ("region", "nation", "customer", "orders")]
    key = (spark.sparkContext.applicationId, tables.files_stamp(spark, inputs))
    if key not in _SNAPSHOTS:
        path = new_folder(spark, "index")
        save_snapshot({"entries": placed(spark, d).repartitionByRange("ext", "name_lower").sortWithinPartitions("ext", "name_lower")}, path)
        _SNAPSHOTS[key] = path
    return load_snapshot(spark, _SNAPSHOTS[key])["entries"]


def parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts as entries of one folder."""
    p = read(spark, d, "part")
    low = F.lower("p_name")
    return p.select(F.lit("C").alias("drive"), F.col("p_partkey").alias("file_ref"), F.col("p_name").alias("name"), low.alias("name_lower"), F.lit(False).alias("is_dir"), F.lit(False).alias("is_junk"), F.concat(F.lit("C:\\parts\\"), "p_name").alias("path"), F.lit(None).cast("string").alias("ext"), F.lit(1).alias("depth"), F.lit(0).alias("user_path"))


TREE_SQL = r"""
t as (
  select 1 + r_regionkey as file_ref, 0 as parent_ref, r_name as name, true as is_dir from region
  union all select 100 + n_nationkey, 1 + n_regionkey, n_name, true from nation
  union all select 1000 + c_custkey, 100 + c_nationkey, c_name, true from customer
  union all select 1000000 + o_orderkey, 1000 + o_custkey, 'order_' || o_orderkey || '.' || lower(o_orderstatus) || '_x', false from orders),
chain(file_ref, levels, junk, usr, prefix) as (
  select file_ref, 0, lower(name) in ('asia', 'nation_7'), lower(name) in ('europe', 'nation_3'), name || '\' from t where parent_ref = 0
  union all
  select d.file_ref, c.levels + 1, c.junk or lower(d.name) in ('asia', 'nation_7'), c.usr or lower(d.name) in ('europe', 'nation_3'), c.prefix || d.name || '\'
  from t d join chain c on d.parent_ref = c.file_ref where d.is_dir),
entries as (
  select t.file_ref, t.parent_ref, t.name, lower(t.name) as name_lower, t.is_dir, least(15, coalesce(c.levels, 0) + 1)::int as depth,
         (coalesce(c.usr, false) or (t.is_dir and lower(t.name) in ('europe', 'nation_3')))::int as user_path, coalesce(c.junk, false) as is_junk,
         'C:\' || coalesce(c.prefix, '') || t.name as path,
         case when contains(t.name, '.') and not ends_with(t.name, '.') then list_extract(string_split(lower(t.name), '.'), -1) end as ext
  from t left join chain c on t.parent_ref = c.file_ref)
"""
TREE = f"with recursive {TREE_SQL}"
_TIER = "case when name_lower = '{q}' then 1 when starts_with(name_lower, '{q}') then 2 when regexp_matches(name_lower, '(^|[^a-z0-9]){q}') then 3 else 4 end"
_PART_MATCHES = f"select p_partkey as file_ref, p_name as name, {_TIER.format(q='ring')} as rank, least(strlen(p_name), 255)::int as name_len, lower(p_name) as name_lower from part where contains(lower(p_name), 'ring')".replace("name_lower", "lower(p_name)").replace("as lower(p_name)", "as name_lower")


@registered(f"select file_ref, name, rank, name_len from ({_PART_MATCHES}) order by rank, name_len, name_lower, file_ref limit 300")
def search_generic(spark, d):
    return search.search_generic(parts(spark, d), "ring").select("file_ref", "name", "rank", "name_len")


@registered(f"select file_ref, name, rank, name_len from ({_PART_MATCHES}) order by rank, name_len, name_lower, file_ref limit 100 offset 100")
def search_paged_p2(spark, d):
    return search.search_generic(parts(spark, d), "ring", limit=100, skip=100).select("file_ref", "name", "rank", "name_len")


@registered(f"select count(*) as total from ({_PART_MATCHES})")
def search_total(spark, d):
    return search.generic_matches(parts(spark, d), "ring").agg(F.count("*").alias("total"))


@registered("select p_partkey, regexp_matches(lower(p_name), '(^|[^a-z0-9])ring') as hit from part")
def search_word_prefix(spark, d):
    return read(spark, d, "part").select("p_partkey", N.word_prefix(F.lower("p_name"), "ring").alias("hit"))


@registered("select p_partkey, case when contains(lower(p_name), ' r') then 4 end::int as tier from part")
def match_tier_sign(spark, d):
    """A query that begins with a separator begins no word here, as the sign before the hit is a letter."""
    return read(spark, d, "part").select("p_partkey", N.match_tier(F.lower("p_name"), " r").alias("tier"))


@registered(f"{TREE} select file_ref, name, path, rank from (select *, {_TIER.format(q='customer#00000001')} as rank from entries where contains(name_lower, 'customer#00000001') and not is_junk) order by rank, least(strlen(name_lower), 255), name_lower, file_ref limit 300")
def tree_search(spark, d):
    return search.search_generic(indexed(spark, d), "customer#00000001").select("file_ref", "name", "path", "rank")


@registered(f"{TREE} select file_ref, ext from entries")
def ext_extract(spark, d):
    return hierarchy.with_names(tree(spark, d)).select("file_ref", "ext")


@registered(f"{TREE} select ext, count(*) as n from entries where ext is not null group by ext")
def ext_counts(spark, d):
    return hierarchy.with_names(tree(spark, d)).where("ext is not null").groupBy("ext").agg(F.count("*").alias("n"))


@registered(f"{TREE} select file_ref, name, depth, user_path from entries where ext = 'o_x' and not is_junk order by user_path desc, depth, strlen(name_lower), name_lower, file_ref limit 300")
def ext_search(spark, d):
    return search.search_extension(indexed(spark, d), "o_x").select("file_ref", "name", "depth", "user_path")


@registered(f"{TREE} select count(*) as total from entries where ext = 'o_x' and not is_junk")
def ext_search_total(spark, d):
    return search.extension_matches(indexed(spark, d), "o_x").agg(F.count("*").alias("total"))


def _pick(values, k):
    """The value at k, counted in a circle."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(k) % len(values) + 1).cast("int"))


def _list_sql(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _pick_sql(values, k):
    return f"list_extract([{_list_sql(values)}], (floor({k}) % {len(values)} + 1)::int)"


_EXTS = (".pdf", ".png", ".zip", ".xyz", ".py", ".mp4", ".gz", ".tar.gz", "", ".", ".7z.txt", ".docx", ".PDF")


@registered(
    f"with named as (select p_partkey, regexp_extract(lower(p_name || {_pick_sql(_EXTS, 'p_partkey')}), '[^.]*$') as ext from part)"
    f" select p_partkey, case when ext in ({_list_sql(sorted(N.DOCUMENT_EXTS))}) then 0 when ext in ({_list_sql(sorted(N.MEDIA_EXTS))}) then 1 when ext in ({_list_sql(sorted(N.ARCHIVE_EXTS))}) then 2 else 3 end::int as ext_prio from named"
)
def ext_priority(spark, d):
    return read(spark, d, "part").select("p_partkey", N.extension_priority(F.lower(F.concat("p_name", _pick(_EXTS, F.col("p_partkey"))))).alias("ext_prio"))


@registered(f"{TREE} select file_ref, path from entries")
def tree_paths(spark, d):
    return placed(spark, d).select("file_ref", "path")


@registered(f"{TREE} select file_ref, depth, user_path, is_junk from entries")
def tree_depth_user(spark, d):
    return placed(spark, d).select("file_ref", "depth", "user_path", "is_junk")


@registered(f"{TREE} select file_ref, name from entries where not is_junk")
def junk_prune(spark, d):
    return hierarchy.prune(tree(spark, d), junk_dirs=JUNK, user_dirs=USER)[0].select("file_ref", "name")


@registered(f"{TREE} select file_ref from entries where is_junk")
def junk_refs(spark, d):
    return hierarchy.prune(tree(spark, d), junk_dirs=JUNK, user_dirs=USER)[1].select("file_ref")


@registered(rf"{TREE} select file_ref, path from entries where not starts_with(lower(path), 'c:\europe\') and not starts_with(lower(path), 'c:\africa\nation_0\')")
def exclude_dirs(spark, d):
    prefixes = ("c:\\europe\\", "c:\\africa\\nation_0\\")
    return indexed(spark, d).where(search.not_excluded(prefixes)).select("file_ref", "path")


@registered(rf"{TREE} select file_ref, path from entries e where not exists (select 1 from nation n join region r on n_regionkey = r_regionkey where n_nationkey % 2 = 0 and starts_with(lower(e.path), lower('C:\' || r_name || '\' || n_name || '\')))")
def exclude_prefix_table(spark, d):
    nations = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 2 = 0")
    prefixes = nations.select(F.concat(F.lit("C:\\"), "r_name", F.lit("\\"), "n_name", F.lit("\\")).alias("prefix"))
    return search.without_prefixes(indexed(spark, d), prefixes).select("file_ref", "path")


@registered(f"{TREE} select file_ref, name, case when is_dir then 'dir' else 'file' end as kind from entries where is_dir")
def kind_filter(spark, d):
    return search.of_kind(indexed(spark, d), "dirs").select("file_ref", "name", N.kind(F.col("is_dir")).alias("kind"))


@registered(f"{TREE} select file_ref, name from (select * from (select *, {_TIER.format(q='order_1')} as rank from entries where contains(name_lower, 'order_1') and not is_junk) order by rank, least(strlen(name_lower), 255), name_lower, file_ref limit 300) where not is_dir")
def post_limit_filter(spark, d):
    return search.of_kind(search.search_generic(indexed(spark, d), "order_1"), "files").select("file_ref", "name")


@registered(f"{TREE} select file_ref, name from entries where not is_dir and ends_with(name_lower, '.f_x') order by name_lower, file_ref limit 300")
def line_extension(spark, d):
    return search.search_line(indexed(spark, d), "ext:f_x").select("file_ref", "name")


@registered(rf"{TREE} select file_ref, path from (select *, strlen(path) - strlen(replace(path, '\', '')) - 1 as level from entries where starts_with(lower(path), 'c:\europe\') and contains(name_lower, 'customer')) where level <= 4 order by case when starts_with(name_lower, 'customer') then 2 else 4 end, is_dir desc, name_lower, file_ref limit 200")
def path_mode(spark, d):
    return search.path_search(indexed(spark, d), "C:\\Europe\\customer").select("file_ref", "path")


@registered("select p_partkey, case when lower(p_name) = 'red' then 0 when starts_with(lower(p_name), 'red') then 1 when regexp_matches(lower(p_name), '[ \\-_.(\\[]red') then 2 when contains(lower(p_name), 'red') then 3 end::int as rank from part")
def app_rank(spark, d):
    return read(spark, d, "part").select("p_partkey", N.app_rank(F.lower("p_name"), "red").alias("rank"))


@registered("select p_name as name, path, cnt from (select p.p_name, 'C:\\apps\\' || p.p_partkey as path, coalesce(n, 0) as cnt, p_partkey, case when starts_with(p_name, 'red') then 1 when contains(p_name, ' red') then 2 else 3 end as rank from part p left join (select l_partkey, count(*) as n from lineitem group by 1) l on l.l_partkey = p.p_partkey where contains(p_name, 'red')) order by rank, cnt desc, p_name, path limit 10")
def app_rank_freq(spark, d):
    apps = read(spark, d, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("C:\\apps\\"), F.col("p_partkey").cast("string")).alias("path"))
    log = read(spark, d, "lineitem").select(F.concat(F.lit("C:\\apps\\"), F.col("l_partkey").cast("string")).alias("path"))
    return search.app_search(apps, catalogue.launches(log), "red").select("name", "path", "cnt")


@registered("select lower('C:\\apps\\' || l_partkey) as path_lower, count(*) as cnt from lineitem group by 1")
def launch_counts(spark, d):
    return catalogue.launches(read(spark, d, "lineitem").select(F.concat(F.lit("C:\\apps\\"), F.col("l_partkey").cast("string")).alias("path")))


def _sources(spark, d):
    c = read(spark, d, "customer").selectExpr("0 as src_prio", "c_custkey as ordinal", "concat('unit ', c_custkey % 700) as name", "concat('C:\\\\c\\\\', c_custkey) as path", "if(c_custkey % 3 = 0, c_mktsegment, null) as install_location", "cast(null as string) as icon")
    s = read(spark, d, "supplier").selectExpr("1 as src_prio", "s_suppkey as ordinal", "concat('Unit ', s_suppkey) as name", "concat('C:\\\\s\\\\', s_suppkey) as path", "concat('at ', s_nationkey) as install_location", "if(s_suppkey % 2 = 0, s_name, null) as icon")
    return c.union(s)


_SOURCES_SQL = "with s as (select 0 as src_prio, c_custkey as ordinal, 'unit ' || (c_custkey % 700) as name, 'C:\\c\\' || c_custkey as path, case when c_custkey % 3 = 0 then c_mktsegment end as install_location, null::varchar as icon from customer union all select 1, s_suppkey, 'Unit ' || s_suppkey, 'C:\\s\\' || s_suppkey, 'at ' || s_nationkey, case when s_suppkey % 2 = 0 then s_name end from supplier)"


@registered(f"{_SOURCES_SQL} select lower(name) as name_key, arg_min(path, src_prio * 1000000000 + ordinal) as path, arg_min(install_location, src_prio * 1000000000 + ordinal) filter (where install_location is not null) as install_location, arg_min(icon, src_prio * 1000000000 + ordinal) filter (where icon is not null) as icon from s group by 1")
def coalesce_merge(spark, d):
    return catalogue.coalesced(_sources(spark, d), ("install_location", "icon")).select("name_key", "path", "install_location", "icon")


@registered(f"{_SOURCES_SQL} select path from (select *, row_number() over (partition by regexp_replace(lower(name), '[^a-z0-9]', '', 'g') order by src_prio, ordinal) as k from s) where k = 1")
def first_by_name(spark, d):
    return catalogue.first_by_name(_sources(spark, d)).select("path")


@registered("select doc_id, source from (select *, row_number() over (partition by source order by doc_id) as k from documents) where k = 1")
def first_per_key(spark, d):
    return first_of_each(read(spark, d, "documents"), ["source"], ["doc_id"]).select("doc_id", "source")


@registered("select user_id, arg_max(event_type, (epoch_us(ts), event_id)) as event_type, max(event_id) as event_id from events group by user_id")
def latest_per_key(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"), F.max("event_id").alias("event_id"))


def _events(spark, d):
    op = F.expr("case event_type when 'signup' then 'created' when 'purchase' then 'created' when 'error' then 'deleted' else 'moved' end")
    return read(spark, d, "events").select(F.lit("C").alias("drive"), F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("file_ref"), F.lit(None).cast("long").alias("old_ref"), (F.col("event_id") % 5).alias("parent_ref"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("name"), F.lit(False).alias("is_dir"))


@registered("select user_id as file_ref, 'e' || max(event_id) as name, max(event_id) % 5 as parent_ref from events group by user_id having arg_max(event_type, event_id) <> 'error'")
def cdc_apply(spark, d):
    events = _events(spark, d)
    half = events.where("seq % 2 = 0"), events.where("seq % 2 = 1")
    state = spark.createDataFrame([], changes.STATE)
    for batch in half:  # in no order of the journal
        state = changes.merged(state, batch)
    return changes.live(state).select("file_ref", "name", "parent_ref")


@registered("select 'half' as pool, (select count(*) from customer where c_custkey % 2 <> 0) = 0 as same union all select 'upper', true")
def pool_equal(spark, d):
    """A pool against half of it and against itself in other case and order."""
    c = read(spark, d, "customer").select(F.col("c_name").alias("path"), "c_custkey")
    half = catalogue.same_pool(c, c.where("c_custkey % 2 = 0")).select(F.lit("half").alias("pool"), "same")
    upper = catalogue.same_pool(c, c.withColumn("path", F.upper("path")).orderBy(F.desc("c_custkey"))).select(F.lit("upper").alias("pool"), "same")
    return half.union(upper)


@registered("select s_nationkey, s_suppkey from (select *, row_number() over (partition by s_nationkey order by s_suppkey % 3, s_suppkey) as k from supplier where s_acctbal > 0) where k = 1")
def hive_priority_lookup(spark, d):
    return catalogue.by_priority(read(spark, d, "supplier"), ["s_nationkey"], F.struct(F.col("s_suppkey") % 3, "s_suppkey"), F.col("s_acctbal") > 0).select("s_nationkey", "s_suppkey")


@registered("select page_id, case page_id % 4 when 0 then regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '') when 1 then regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '') when 2 then 'h' || page_id || '.net' end as host from pages")
def url_host(spark, d):
    """Hosts of urls as they are, with another scheme, with a user and a port, and of no url."""
    url, path = F.col("url"), F.regexp_replace("url", "^[a-z]+://", "")
    n = F.col("page_id") % 4
    asked = F.when(n == 0, url).when(n == 1, F.concat(F.lit("ftp://"), path)).when(n == 2, F.concat(F.lit("https://me@www.h"), F.col("page_id").cast("string"), F.lit(".net:8080/a"))).otherwise(F.concat(F.lit("no url "), F.col("page_id").cast("string")))
    return read(spark, d, "pages").select("page_id", X.host_of(asked).alias("host"))


@registered("select page_id, starts_with(url, 'http://') or starts_with(url, 'https://') or regexp_matches(url, '\\.(com|net|org)') as is_url from pages")
def looks_like_url(spark, d):
    return read(spark, d, "pages").select("page_id", N.looks_like_url(F.col("url")).alias("is_url"))


@registered("with p as (select page_id, regexp_replace(regexp_replace(html, '<[^>]*(>|$)', ' ', 'g'), ' +', ' ', 'g') as t from pages) select page_id, trim(case when strlen(t) > 200 then substring(t, 1, list_max([k for k in range(50, 201) if strlen(substring(t, 1, k)) <= 200])) || '…' else t end, ' ') as snippet from p")
def strip_html(spark, d):
    return read(spark, d, "pages").select("page_id", X.strip_html(F.col("html")).alias("snippet"))


@registered("select page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&#39;', ''''), '&amp;', '&') as text from pages")
def xml_unescape(spark, d):
    return read(spark, d, "pages").select("page_id", X.unescape_xml(F.col("html")).alias("text"))


@registered("select event_id, json_extract_string(props, '$.k') as k from events")
def json_extract(spark, d):
    return read(spark, d, "events").select("event_id", X.json_field(F.col("props"), "$.k").alias("k"))


@registered("select doc_id, url_encode(text) as encoded from documents")
def url_encode(spark, d):
    """Whole texts with letters of several languages, marks and line ends."""
    return read(spark, d, "documents").select("doc_id", X.url_encode(F.col("text")).alias("encoded"))


_WORD = "list_sum([case when embedding[i] > 0 then 1::bigint << (i - {first}) else 0 end for i in range({first}, {end})])::bigint"


@registered(f"with w as (select vec_id, label, {_WORD.format(first=1, end=33)} as a, {_WORD.format(first=33, end=65)} as b from embeddings), p as (select *, lag(a) over (partition by label order by vec_id) as pa, lag(b) over (partition by label order by vec_id) as pb from w) select vec_id, (bit_count(xor(a, pa)) + bit_count(xor(b, pb)))::int as distance, bit_count(xor(a, pa)) + bit_count(xor(b, pb)) <= 24 as same from p where pa is not null")
def hamming_previous(spark, d):
    """Each vector's sign words against those of the one before it under its label: the same up to 24 differing bits."""
    words = read(spark, d, "embeddings").select("vec_id", "label", X.sign_bits(F.col("embedding")).alias("w"))
    whole = with_previous(words, "label", "vec_id", "w", "before").where("before is not null").withColumn("distance", X.hamming(F.col("w"), F.col("before")))
    return whole.select("vec_id", "distance", (F.col("distance") <= 24).alias("same"))


@registered("select doc_id, case when n_chars < 1024 then n_chars || ' B' when n_chars < 1048576 then printf('%.1f KB', floor(n_chars / 102.4 + 0.5) / 10) else printf('%.1f MB', floor(n_chars / 104857.6 + 0.5) / 10) end as size from documents")
def fmt_size(spark, d):
    return read(spark, d, "documents").select("doc_id", X.format_size(F.col("n_chars")).alias("size"))


@registered("with a as (select event_id, event_id * 977 as age from events) select event_id, case when age < 60 then 'just now' when age < 3600 then (age // 60) || ' min ago' when age < 86400 then (age // 3600) || ' h ago' when age < 2592000 then (age // 86400) || ' d ago' else (age // 604800) || ' wk ago' end as ago from a")
def fmt_age(spark, d):
    return read(spark, d, "events").select("event_id", X.format_age(F.col("event_id") * 977).alias("ago"))


@registered("with a as (select event_id, event_id * 7 as age from events) select event_id, case when age < 45 then 'just now' when age < 3600 then (age // 60) || ' min ago' when age < 86400 then (age // 3600) || ' hr ago' else (age // 86400) || ' days ago' end as ago from a")
def fmt_relative(spark, d):
    return read(spark, d, "events").select("event_id", X.format_relative(F.col("event_id") * 7).alias("ago"))


@registered(rf"{TREE} select file_ref, case when length(path) <= 48 then path when length(short) < length(path) then short else path end as short from (select *, list_extract(string_split(path, '\'), 1) || '\' || list_extract(string_split(path, '\'), 2) || '\…\' || list_extract(string_split(path, '\'), -2) || '\' || list_extract(string_split(path, '\'), -1) as short from entries)")
def truncate_path(spark, d):
    return indexed(spark, d).select("file_ref", X.truncate_path(F.col("path")).alias("short"))


@registered("select c_custkey, case when c_custkey % 6 = 4 then 'customer' || lpad(c_custkey::varchar, 9, '0') || 'x86' when c_custkey % 6 = 5 then 'customer' || lpad(c_custkey::varchar, 9, '0') || '2012' else 'customer' || lpad(c_custkey::varchar, 9, '0') end as name_norm from customer")
def norm_name(spark, d):
    """Names with suffixes that go (shortcut, channel, version, user) and ones that stay (an architecture or a year alone)."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in (" Stable 1.2.3 (x64) - Shortcut", " (User)", " Browser", " 2.1.4", " (x86)", " 2012")]), (F.col("c_custkey") % 6 + 1).cast("int"))
    return read(spark, d, "customer").select("c_custkey", N.normalized_app_name(F.concat("c_name", suffix)).alias("name_norm"))


def _fuzzy_sql(name: str, query: str, rows: str, kept: str) -> str:
    """`kept` and score of the query as a greedy subsequence of `name`: places one after the other, then what each gives."""
    sql = f"select *, {name} as fz, -1 as q0 from {rows}"
    for k, c in enumerate(query, 1):
        sql = f"select *, case when q{k - 1} <> 0 and instr(substring(fz, greatest(q{k - 1}, 0) + 1), '{c}') > 0 then greatest(q{k - 1}, 0) + instr(substring(fz, greatest(q{k - 1}, 0) + 1), '{c}') else 0 end as q{k} from ({sql})"
    one = " + ".join(f"case when q{k} = 1 or substring(fz, q{k} - 1, 1) in (' ', '-', '_', '.', '(', '[') then 4 when q{k} - q{k - 1} = 1 then 3 else greatest(0, 3 - (q{k} - q{k - 1})) end" for k in range(1, len(query) + 1))
    return f"select {kept}, (case when q{len(query)} = 0 then -1 else {one} end)::int as score from ({sql})"


@registered(_fuzzy_sql("lower(p_name)", "ldt", "part", "p_partkey"))
def fuzzy_score(spark, d):
    return read(spark, d, "part").select("p_partkey", X.fuzzy_score(F.lower("p_name"), "ldt").alias("score"))


@registered(f"select 'C' as drive, p_partkey as file_ref, p_name as name, 'C:\\parts\\' || p_name as path, false as is_dir, 5 as rank from ({_fuzzy_sql('lower(p_name)', 'rdwdg', 'part', '*')}) where score >= 0 order by score desc, lower(p_name), p_partkey limit 200")
def fuzzy_search(spark, d):
    return search.search_paged(parts(spark, d), "rdwdg")[0]


@registered(f"select p_name as name, rank, p_partkey as ordinal from (select *, case when starts_with(p_name, 'old') then 1 when regexp_matches(p_name, '[ \\-_.(\\[]old') then 2 when contains(p_name, 'old') then 3 when score >= 0 then 4 end::int as rank from ({_fuzzy_sql('p_name', 'old', 'part', '*')})) where rank is not null order by rank, case when rank = 4 then score else -1 end desc, p_name, p_partkey limit 16")
def client_app_search(spark, d):
    return search.client_app_search(_part_apps(spark, d), "old").select("name", "rank", "ordinal")


@registered(f"select p_name as name, p_partkey as ordinal from ({_fuzzy_sql('p_name', 'sldg', 'part', '*')}) where score >= 0 and not contains(p_name, 'sldg') order by score desc, p_name, p_partkey limit 16")
def client_app_fuzzy(spark, d):
    """No name has the query in it, so all found are subsequences."""
    return search.client_app_search(_part_apps(spark, d), "sldg").select("name", "ordinal")


def _part_apps(spark, d):
    return read(spark, d, "part").select(F.col("p_name").alias("name"), F.concat(F.lit("C:\\apps\\"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("ordinal"))


@registered("select p_name as name, 'C:\\apps\\' || p_partkey as path, 0 as rank from part order by lower(p_name), path limit 50")
def first_apps(spark, d):
    return search.first_apps(_part_apps(spark, d), 50).select("name", "path", "rank")


@registered(
    "with x as (select l_orderkey, l_linenumber, l_linenumber::bigint as n, l_orderkey as o, l_orderkey % 6 as kind from lineitem)"
    " select l_orderkey, l_linenumber, case kind when 0 then (n * 3 + o)::varchar when 1 then (-(n * n))::varchar when 2 then (o * (n + 2) - 7 % n)::varchar when 3 then (n ** 3)::bigint::varchar when 4 then null"
    " else rtrim(rtrim(printf('%.9f', floor((n / 8.0) * 1000000000.0 + 0.5) / 1000000000.0), '0'), '.') end as value from x"
)
def math_eval(spark, d):
    """Precedence, signs over powers, parentheses and remainders, powers to the right, a division by zero, a fraction."""
    n, o = F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [text(n, " * 3 + ", o), text("-", n, "^2"), text(o, "*(", n, "+2) - 7 % ", n), text(n, "^3^1"), text(o, "/(", n, "-", n, ")"), text("+", n, "/8.")]
    chosen = F.element_at(F.array(*forms), (F.col("l_orderkey") % 6 + 1).cast("int"))
    return tables.spread(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", chosen.alias("text"))).select("l_orderkey", "l_linenumber", X.math_value(F.col("text")).alias("value"))


@registered("select p_partkey, ([i - 1 for i in range(1, length(p_name) + 1) if lower(p_name)[i] = 'l'])[1:3]::varchar as starts from part")
def highlight(spark, d):
    """The first three hits of a letter, double letters and upper case among them."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    starts = F.transform(search.highlights(name, "l"), lambda h: h["start"].cast("string"))
    return read(spark, d, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(starts, ", "), F.lit("]")).alias("starts"))


@registered("select doc_id, regexp_replace(substring(text, 1, 1024), '[\\r\\n]', ' ', 'g') as line from documents")
def log_sanitise(spark, d):
    return read(spark, d, "documents").select("doc_id", X.log_line(F.col("text")).alias("line"))


@registered("select p_partkey, 'https://www.google.com/search?q=' || replace(p_name, ' ', '+') as target from part")
def web_search_url(spark, d):
    return read(spark, d, "part").select("p_partkey", X.search_url(F.col("p_name")).alias("target"))


@registered("select 'records' as table_name, (select count(*) from region) + (select count(*) from nation) + (select count(*) from customer) + (select count(*) from orders) as n union all select 'roots', 1")
def snapshot_counts(spark, d):
    """The tree saved as a snapshot, loaded and described."""
    path = new_folder(spark, "snapshot")
    save_snapshot({"records": tree(spark, d), "roots": spark.createDataFrame([("C", "C:\\")], "drive string, root string")}, path)
    return describe_snapshot(load_snapshot(spark, path))


@registered(f"with m as (select *, row_number() over (order by rank, name_len, name_lower, file_ref) as k from ({_PART_MATCHES})) select file_ref, name from m where k > 50 and k <= 150 and name not in (select name from m where k <= 50)")
def next_page(spark, d):
    """Rows 51 to 150 whose path isn't on the first page."""
    first, more = search.search_generic(parts(spark, d), "ring", 50), search.search_generic(parts(spark, d), "ring", 100, 50)
    return search.next_page(more, first).select("file_ref", "name")


@registered(
    f"with recursive gone as (select 1000 + c_custkey as file_ref from customer where c_acctbal < 0), {TREE_SQL.replace('from t d join chain c', 'from t d anti join gone using (file_ref) join chain c')}"
    " select file_ref, depth, path from entries anti join gone using (file_ref)"
)
def cdc_tree_paths(spark, d):
    """Paths after the deletion of customers in debt; their orders stay, at the root."""
    debt = read(spark, d, "customer").where("c_acctbal < 0")
    deleted = debt.selectExpr("'C' as drive", "c_custkey + 1 as seq", "'deleted' as op", "1000 + c_custkey as file_ref", "cast(null as bigint) as old_ref", "0L as parent_ref", "c_name as name", "true as is_dir")
    state = changes.merged(changes.from_scan(tree(spark, d)), deleted)
    return hierarchy.with_ancestry(changes.live(state), junk_dirs=JUNK, user_dirs=USER).select("file_ref", "depth", "path")


_LOG = "case p_partkey % 5 when 0 then 'Log' || p_partkey || '.LOG' when 1 then 'my ' || p_name || '.log' when 2 then p_partkey || '.log' when 3 then '.log' else 'x.txt' end"


@registered(
    f"with e as (select p_partkey as file_ref, lower({_LOG}) as n, (p_partkey % 7 = 0)::int as user_path, 1 + p_partkey % 3 as depth from part), r as (select *, case when n = '.log' then 1 when starts_with(n, 'log') then 2 else 3 end as rank from e where ends_with(n, '.log'))"
    " select file_ref, rank, 0 as boundary, user_path, depth::int as depth from r order by rank, user_path desc, depth, least(strlen(n), 255), n, file_ref limit 300"
)
def ext_ranks(spark, d):
    """An extension's page over names that are it, begin with it, or have it alone, in user directories and others."""
    key = F.col("p_partkey")
    text, k = key.cast("string"), key % 5
    name = F.when(k == 0, F.concat(F.lit("Log"), text, F.lit(".LOG"))).when(k == 1, F.concat(F.lit("my "), "p_name", F.lit(".log"))).when(k == 2, F.concat(text, F.lit(".log"))).when(k == 3, ".log").otherwise("x.txt")
    rows = read(spark, d, "part").select(F.lit("C").alias("drive"), key.alias("file_ref"), name.alias("name"), (k == 3).alias("is_dir"), F.lit(False).alias("is_junk"), (key % 7 == 0).cast("int").alias("user_path"), (1 + key % 3).cast("int").alias("depth"))
    found = search.search_extension(hierarchy.with_names(rows), "log")
    return found.select("file_ref", "rank", "boundary", "user_path", "depth")


_FILLED = "ld t"


@registered(
    f"with lit as (select p_partkey as file_ref, p_name as name, {_TIER.format(q=_FILLED)} as rank, least(strlen(p_name), 255) as len from (select *, lower(p_name) as name_lower from part) where contains(name_lower, '{_FILLED}')), n as (select count(*) as c from lit),"
    f" fz as (select p_partkey as file_ref, p_name as name, row_number() over (order by score desc, lower(p_name), p_partkey) as k from ({_fuzzy_sql('lower(p_name)', _FILLED, 'part', '*')}) where score >= 0 and not contains(lower(p_name), '{_FILLED}'))"
    " (select file_ref, name, rank from lit order by rank, len, lower(name), file_ref limit 300) union all select file_ref, name, 5 from fz, n where c < 300 and k <= least(200, 300 - c)"
)
def filled_page(spark, d):
    """A first page of names with the query in them, filled by names that have it as a subsequence and aren't on the page."""
    return search.search_paged(parts(spark, d), _FILLED)[0].select("file_ref", "name", "rank")


def _substring_index(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """The postings of the tree's names, built by the first query that asks for these very files."""
    inputs = [f"{d}/{table}.parquet" for table in ("region", "nation", "customer", "orders")]
    key = (spark.sparkContext.applicationId, "postings " + tables.files_stamp(spark, inputs))
    if key not in _SNAPSHOTS:
        path = new_folder(spark, "postings")
        substring.build(indexed(spark, d), path)
        _SNAPSHOTS[key] = path
    return substring.load(spark, _SNAPSHOTS[key])


@registered(f"{TREE} select file_ref, name, path, rank from (select *, {_TIER.format(q='077')} as rank from entries where contains(name_lower, '077') and not is_junk) order by rank, least(strlen(name_lower), 255), name_lower, file_ref limit 300")
def substring_search(spark, d):
    """A first page by three letters, from the postings of names."""
    return search.search_generic(substring.entries_with(_substring_index(spark, d), "077"), "077").select("file_ref", "name", "path", "rank")


@registered(f"{TREE} select q, count(*) as raw_total from entries, (values ('07'), ('0077'), ('der_1'), ('asia')) as t(q) where contains(name_lower, q) group by q")
def substring_totals(spark, d):
    """Names with two, four, five letters and a whole name in them."""
    index = _substring_index(spark, d)
    one = lambda q: search.raw_total(substring.entries_with(index, q), q).select(F.lit(q).alias("q"), "raw_total")
    return one("07").union(one("0077")).union(one("der_1")).union(one("ASIA").select(F.lower("q").alias("q"), "raw_total"))


@registered(
    f"with recursive moved as (select 1000 + c_custkey as file_ref, case when c_acctbal < 0 then 107 else 4 end as to_ref from customer where c_acctbal < 0 or c_acctbal > 9000), gone as (select 100 + n_nationkey as file_ref from nation where n_nationkey % 10 = 9),"
    f" {TREE_SQL.replace('t as (', 't0 as (', 1).replace('chain(file_ref', 't as (select t0.file_ref, coalesce(to_ref, parent_ref) as parent_ref, name, is_dir from t0 left join moved using (file_ref) anti join gone using (file_ref)), chain(file_ref', 1).replace('select file_ref, 0, lower', 'select file_ref, (parent_ref <> 0)::int, lower').replace('from t where parent_ref = 0', 'from t where is_dir and parent_ref not in (select file_ref from t where is_dir)')}"
    " select file_ref, depth, user_path, is_junk, path from entries"
)
def incremental_placement(spark, d):
    """A tree placed once, then customers moved in and out of junk and nations deleted: only their subtrees are restamped."""
    path, options = new_folder(spark, "placed"), {"junk_dirs": JUNK, "user_dirs": USER}
    placement.begin_placed(spark, path, tree(spark, d), {"C": 0}, **options)
    event = "'C' as drive", "cast(null as bigint) as old_ref", "true as is_dir"
    c = read(spark, d, "customer").where("c_acctbal < 0 or c_acctbal > 9000")
    moved = c.selectExpr(*event, "c_custkey + 1 as seq", "'moved' as op", "1000 + c_custkey as file_ref", "if(c_acctbal < 0, 107L, 4L) as parent_ref", "c_name as name")
    gone = read(spark, d, "nation").where("n_nationkey % 10 = 9").selectExpr(*event, "10000000L + n_nationkey as seq", "'deleted' as op", "100L + n_nationkey as file_ref", "0L as parent_ref", "n_name as name")
    for batch in (moved, gone):
        placement.place_batch(spark, path, batch.select("drive", "seq", "op", "file_ref", "old_ref", "parent_ref", "name", "is_dir"), **options)
    return placement.placed_entries(spark, path).select("file_ref", "depth", "user_path", "is_junk", "path")


@registered("select user_id as file_ref, 'e' || max(event_id) as name, max(event_id) % 5 as parent_ref from events group by user_id having arg_max(event_type, event_id) <> 'error'")
def cdc_log_state(spark, d):
    """All events in four batches, the second one twice, through the log-structured state."""
    path, events = new_folder(spark, "state"), _events(spark, d)
    for k in (0, 2, 2, 1, 3):
        changes.apply_batch(spark, path, events.where(F.col("seq") % 4 == k))
    return changes.live(changes.load_state(spark, path)[0]).select("file_ref", "name", "parent_ref")


@registered(f"{TREE} select count(*) as raw_total from entries where contains(name_lower, 'customer#00000001')")
def raw_total(spark, d):
    return search.raw_total(indexed(spark, d), "customer#00000001")


@registered(f"{TREE} select 'C' as drive, count(*) as n, min(file_ref) as low, max(file_ref) as high from entries")
def refs_per_drive(spark, d):
    return indexed(spark, d).groupBy("drive").agg(F.count("*").alias("n"), F.min("file_ref").alias("low"), F.max("file_ref").alias("high"))


@registered(
    rf"""{TREE}, roots(drive, root) as (values ('D', 'D:\'))
    select 'roots_exist' as "check", count(*) > 0 as ok from roots union all select 'roots_named', bool_and(drive is not null and root <> '') from roots
    union all select 'refs_and_names', count(*) = count(file_ref) and count(*) = count(name) from entries
    union all select 'depths_in_range', min(depth) >= 1 and max(depth) <= 15 and min(user_path) >= 0 and max(user_path) <= 1 from entries
    union all select 'refs_once', count(*) = count(distinct file_ref) from entries union all select 'drives_rooted', 'C' in (select drive from roots) from (select 1)"""
)
def snapshot_checks(spark, d):
    """The index against roots of another drive: all checks hold but that."""
    return tables.validate_snapshot({"entries": indexed(spark, d), "roots": spark.createDataFrame([("D", "D:\\")], "drive string, root string")})


_LINE_HEADS = ("", "C:\\", "c:/", "~", "~/", "%TEMP%\\", "%x y%", "%x%/", "AppData/", "windows/", "Program Files (x86)/", "\\\\srv", '"D:\\', "3*(", "12", "+-", "C:", "1.5 ^ ", '""~')
_LINE_TAILS = ("", "x\\y", "4+1)", " 7", "100%", '"', "/z", "ring")
_LINE_FOLDERS = ("appdata", "localappdata", "temp", "userprofile", "programfilesx86", "programfiles", "program files", "program files (x86)", "windows", "system32")


@registered(
    f"with lines as (select p_partkey, {_pick_sql(_LINE_HEADS, 'p_partkey')} || {_pick_sql(_LINE_TAILS, f'p_partkey / {len(_LINE_HEADS)}')} as line from part), bared as (select *, trim(line, '\"') as bare from lines)"
    + rf""" select p_partkey, case
      when contains(bare, '\') or bare = '~' or starts_with(bare, '~/') or (bare[2:2] = ':' and lower(bare[1:1]) between 'a' and 'z' and bare[3:3] in ('', '/'))
        or (contains(bare, '/') and lower(split_part(bare, '/', 1)) in ({_list_sql(_LINE_FOLDERS)}))
        or (starts_with(bare, '%') and split_part(bare, '%', 2) <> '' and not contains(split_part(bare, '%', 2), '/') and contains(bare[2:], '%')
            and (bare = '%' || split_part(bare, '%', 2) || '%' or starts_with(bare, '%' || split_part(bare, '%', 2) || '%/'))) then 'path'
      when translate(line, '0123456789+-*/().% ^', '') = '' and translate(line, '0123456789', '') <> line and translate(line, '+-*/%^', '') <> line then 'math'
      else 'name' end as kind from bared"""
)
def line_kind(spark, d):
    line = F.concat(_pick(_LINE_HEADS, F.col("p_partkey")), _pick(_LINE_TAILS, F.col("p_partkey") / len(_LINE_HEADS)))
    return read(spark, d, "part").select("p_partkey", search.line_kind(line).alias("kind"))


_TARGET_HEADS = ("C:\\x\\", "C:\\ProgramData\\Package Cache\\", "aumid:", "\\\\srv\\", "\\\\.\\", "", "http://", "c:/", "ms-", "shell:::", "Uninstall ")
_TARGET_TAILS = ("cmd.exe", "a.HTML", "unins000.exe", "app.exe", "msiexec.exe", "powershell.exe", "http://x", ".url", "x Command Prompt")


@registered(
    rf"""with targets as (select s_suppkey, {_pick_sql(_TARGET_HEADS, "s_suppkey")} || {_pick_sql(_TARGET_TAILS, f"s_suppkey / {len(_TARGET_HEADS)}")} as t from supplier),
    named as (select *, lower(t) as low, regexp_replace(lower(regexp_extract(t, '[^\\/]*$')), '^(.+)\.[^.]*$', '\1') as stem, starts_with(t, '\\.\') or starts_with(t, '\\?\') as device, case when starts_with(lower(t), 'aumid:') then lower(t)[7:] else '' end as rest from targets)
    select s_suppkey, starts_with(low, 'http') or suffix(low, '.url') or suffix(low, '.html') or suffix(low, '.htm') or stem = '' or stem in ({_list_sql(sorted(N.SHELLS))}) or contains(stem, 'unins') as shortcut_junk,
      contains(low, '\package cache\') or suffix(low, '\package cache') or contains(stem, 'unins') as installer_junk,
      (lower(t[1:1]) between 'a' and 'z' and t[2:2] = ':' and t[3:3] in ('/', '\')) or (starts_with(t, '\\') and not device) or starts_with(t, 'aumid:') or starts_with(t, 'ms-') or starts_with(t, 'shell:::') as launchable,
      starts_with(rest, 'http') or suffix(rest, '.url') or suffix(rest, '.html') or suffix(rest, '.htm') or starts_with(low, 'uninstall ') or starts_with(low, 'install ') or suffix(low, ' command prompt') as shell_junk,
      device as device_path, stem not in ({_list_sql(sorted(N.INTERPRETERS))}) and (contains(t, '\') or contains(t, '/') or stem = 'msiexec') as uninstaller_allowed from named"""
)
def path_predicates(spark, d):
    target = F.concat(_pick(_TARGET_HEADS, F.col("s_suppkey")), _pick(_TARGET_TAILS, F.col("s_suppkey") / len(_TARGET_HEADS)))
    rows = read(spark, d, "supplier").select("s_suppkey", target.alias("t"))
    t = F.col("t")
    return rows.select("s_suppkey", N.shortcut_junk(t).alias("shortcut_junk"), N.installer_junk(t).alias("installer_junk"), N.launchable(t).alias("launchable"), N.shell_junk(t, t).alias("shell_junk"), N.device_path(t).alias("device_path"), N.uninstaller_allowed(t).alias("uninstaller_allowed"))


_FOLDER_IDS = ("{1AC14E77-02E7-4E5D-B744-2EB1AE5198B7}\\", "{6d809377-6af0-444b-8957-a3773f02200e}\\", "{0}\\", "none ", "{D65231B0-b2f1-4857-a4ce-a8e7c6ea7d27}\\a\\", "{6d809377-6af0-444b-8957-a3773f02200e}", "\\")


@registered(
    rf"""with ids as (select s_suppkey, {_pick_sql(_FOLDER_IDS, "s_suppkey")} || s_name as id from supplier),
    folders(folder, base) as (values ({"), (".join(_list_sql(pair) for pair in N.KNOWN_FOLDERS.items())}))
    select s_suppkey, base || id[strpos(id, '\'):] as path from ids left join folders on contains(id, '\') and lower(split_part(id, '\', 1)) = folder"""
)
def known_folders(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", N.known_folder_path(F.concat(_pick(_FOLDER_IDS, F.col("s_suppkey")), "s_name")).alias("path"))


@registered(
    r"with files as (select 'C:\s' || s_nationkey || '\' || lower(s_name) || '.exe' as path, s_suppkey, 's' || s_nationkey as folder, s_nationkey from supplier)"
    r" select 'Supplier #' || lpad(s_suppkey::varchar, 9, '0') as app, case s_suppkey % 4 when 3 then null else path end as path from files where s_suppkey % 4 <> 3"
)
def executables(spark, d):
    """Of a shown icon, an icon beside it, an install location and an uninstaller beside it; the last kind names a file that isn't there."""
    s = read(spark, d, "supplier").withColumn("home", F.concat(F.lit("C:\\s"), F.col("s_nationkey").cast("string"))).withColumn("exe", F.concat("home", F.lit("\\"), F.lower("s_name"), F.lit(".exe")))
    kind, null = F.col("s_suppkey") % 4, F.lit(None).cast("string")
    apps = s.select(
        F.concat(F.lit("Supplier #"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("app"),
        F.when(kind == 0, F.concat(F.lit('"'), F.upper("exe"), F.lit('",3'))).alias("icon"),
        F.when(kind == 1, F.concat("home", F.lit("\\"))).otherwise(null).alias("install_location"),
        F.when(kind == 2, F.concat(F.lit('"'), "home", F.lit('\\unins000.exe" /S'))).when(kind == 3, F.concat("home", F.lit("\\gone.exe /S"))).alias("uninstall_string"),
        F.when(kind == 1, F.col("exe")).alias("quiet_uninstall_string"),
    )
    files = s.select(F.col("exe").alias("path"), F.col("s_suppkey").alias("ordinal")).unionByName(s.select("home").distinct().select(F.concat("home", F.lit("\\unins000.exe")).alias("path"), F.lit(-1).cast("long").alias("ordinal")))
    return catalogue.executables(apps, files)


@registered("select s_nationkey as app, max_by('C:\\' || lower(s_name) || '.exe', -s_suppkey) as path from supplier group by 1")
def best_executable(spark, d):
    """Of each nation's suppliers the first whose file has the name of the application in it."""
    rows = read(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.lit("Supplier #").alias("app"), F.concat(F.lit("C:\\"), F.lower("s_name"), F.lit(".exe")).alias("path"), F.col("s_suppkey").alias("ordinal"))
    return catalogue.best_executable(rows, ["key"]).select(F.col("key").alias("app"), "path")


@registered("select n_name as drive, not (n_nationkey % 4 <> 0 and n_nationkey % 4 <> 1 and n_nationkey * 2 between 10 and 40) as rescan from nation")
def rescans(spark, d):
    """Drives without a checkpoint, of another journal, and inside and outside the journal's range."""
    n = read(spark, d, "nation")
    drives = n.select(F.col("n_name").alias("drive"), F.lit(1).cast("long").alias("journal_id"), F.lit(10).cast("long").alias("first_seq"), F.lit(40).cast("long").alias("next_seq"))
    seen = n.where("n_nationkey % 4 <> 0").select(F.col("n_name").alias("drive"), F.when(F.col("n_nationkey") % 4 == 1, 2).otherwise(1).cast("long").alias("journal_id"), (F.col("n_nationkey") * 2).cast("long").alias("next_seq"))
    return changes.rescans(drives, seen)


@registered("select distinct lower(trim(r_name)) || '\\' as prefix from region")
def exclusion_lines(spark, d):
    """Prefixes written as lines, with space around, in upper case and with empty ones between, and read back."""
    path = new_folder(spark, "exclusions")
    r = read(spark, d, "region")
    tables.write_exclusions(r.select(F.concat(F.lit("  "), F.upper("r_name"), F.lit("\\ ")).alias("prefix")).union(r.select(F.lit("  "))), path)
    return tables.read_exclusions(spark, path)


@registered("select c_name as name, 'C:\\' || c_custkey as path from customer where c_custkey % 3 = 0")
def pool_json(spark, d):
    """An application pool written as JSON and read back; paths that may not be launched go."""
    path = new_folder(spark, "pool")
    kind, key = F.col("c_custkey") % 3, F.col("c_custkey").cast("string")
    tables.write_pool(read(spark, d, "customer").select(F.col("c_name").alias("name"), F.when(kind == 0, F.concat(F.lit("C:\\"), key)).when(kind == 1, F.concat(F.lit("\\\\?\\"), key)).otherwise(key).alias("path")), path)
    return tables.read_pool(spark, path)


@registered("select c_custkey, 'data:image/png;base64,' || base64(encode(c_name)) as uri, c_name as name from customer")
def data_uri(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", "c_name", X.data_uri(F.encode("c_name", "UTF-8")).alias("uri"))
    return rows.select("c_custkey", "uri", X.data_uri_bytes(F.col("uri")).cast("string").alias("name"))


@registered(
    f"{TREE}, moved as (select 1000 + c_custkey as file_ref, case when c_acctbal < 0 then 107 else 4 end as to_ref from customer where c_acctbal < 0 or c_acctbal > 9000),"
    " new_parent as (select t.file_ref, coalesce(m.to_ref, t.parent_ref) as parent_ref, t.name, t.is_dir from t left join moved m using (file_ref)),"
    " c2(file_ref, junk) as (select file_ref, lower(name) in ('asia', 'nation_7') from new_parent where parent_ref = 0 union all select d.file_ref, c.junk or lower(d.name) in ('asia', 'nation_7') from new_parent d join c2 c on d.parent_ref = c.file_ref where d.is_dir)"
    " select e.file_ref, case when m.file_ref is not null then coalesce(c2.junk, false) else e.is_junk or coalesce(c2.junk, false) end as is_junk"
    " from entries e join new_parent n using (file_ref) left join c2 on n.parent_ref = c2.file_ref left join moved m on e.file_ref = m.file_ref"
)
def cdc_junk(spark, d):
    """Customers moved into a junk directory take their orders with them; ones moved out of one leave theirs, which were pruned."""
    entries, refs = hierarchy.prune(tree(spark, d), junk_dirs=JUNK, user_dirs=USER)
    c = read(spark, d, "customer").where("c_acctbal < 0 or c_acctbal > 9000")
    moved = c.selectExpr("'C' as drive", "c_custkey + 1 as seq", "'moved' as op", "1000 + c_custkey as file_ref", "cast(null as bigint) as old_ref", "if(c_acctbal < 0, 107L, 4L) as parent_ref", "c_name as name", "true as is_dir")
    state = changes.merged(changes.from_scan(entries), moved)
    now, junk = changes.with_junk(state, refs, junk_dirs=JUNK, user_dirs=USER)
    return now.select("file_ref", F.lit(False).alias("is_junk")).unionByName(junk.select("file_ref", F.lit(True).alias("is_junk")))


_BITS = "list_sum([case when embedding[b + b // 7 + 1] > embedding[b + b // 7 + 2] then 1::bigint << (b - {first}) else 0 end for b in range({first}, {end})])::bigint"


@registered(f"select vec_id, {_BITS.format(first=0, end=32)} as low, {_BITS.format(first=32, end=56)} as high from embeddings")
def image_hash(spark, d):
    """Each vector as an image of 8 by 8 pixels, hashed at its own size."""
    words = X.difference_hash(F.col("embedding"), F.lit(8), F.lit(8), columns=8, rows=8)
    return read(spark, d, "embeddings").select("vec_id", words.alias("w")).select("vec_id", F.get("w", F.lit(0)).alias("low"), F.get("w", F.lit(1)).alias("high"))


@registered(
    f"{TREE}, files as (select *, {_TIER.format(q='0000001')} as rank from entries where contains(name_lower, '0000001') and not is_junk order by rank, least(strlen(name_lower), 255), name_lower, file_ref limit 300)"
    " select 0 as section, 'Web' as label, 1 as n, 0 as more union all select 2, 'Applications', count(*), 0 from (select 1 from part where contains(p_name, 'red') limit 10) having count(*) > 0"
    " union all select case when is_dir then 3 else 4 end, case when is_dir then 'Folders' else 'Files' end, count(*), 0 from files group by 1, 2"
)
def section_counts(spark, d):
    """One list of a web row, applications and entries, counted by its sections."""
    row = lambda frame: frame.select("name", "path", "is_dir", F.col("rank").cast("int").alias("rank"))
    web = read(spark, d, "region").where("r_regionkey = 0").select(F.col("r_name").alias("name"), F.lit("web").alias("path"), F.lit(False).alias("is_dir"), F.lit(0).alias("rank"))
    none = spark.createDataFrame([], "path_lower string, cnt long")
    apps = search.app_search(_part_apps(spark, d), none, "red").withColumn("is_dir", F.lit(False))
    whole = search.sections(web, row(apps), row(search.search_generic(indexed(spark, d), "0000001")))
    return search.section_counts(whole)


@registered("select p_partkey, p_name from part where p_partkey % 7 <> 0 and p_name is not null")
def listing_round_trip(spark, d):
    """A listing dumped as JSON with records that lack a name, and read with the scan's schema."""
    path = new_folder(spark, "listing")
    p = read(spark, d, "part")
    p.select(F.lit("C").alias("drive"), F.col("p_partkey").alias("file_ref"), F.lit(0).alias("parent_ref"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("name"), F.lit(False).alias("is_dir"), "p_brand").write.json(path)
    return files.read_listing(spark, path, "json").select(F.col("file_ref").alias("p_partkey"), F.col("name").alias("p_name"))


@registered(r"select name, target from (select 'Tool ' || s_suppkey as name, 'c:\t\' || (s_suppkey % 40) || '.exe' as target, row_number() over (partition by s_suppkey % 40 order by length('Tool ' || s_suppkey) // 8, s_suppkey) as k from supplier) where k = 1")
def one_of_target(spark, d):
    """Shortcuts to shared executables: of each target the best named one, ties to the earlier."""
    s = read(spark, d, "supplier")
    apps = s.select(F.concat(F.lit("Tool "), F.col("s_suppkey").cast("string")).alias("name"), F.concat(F.lit("C:\\L\\"), F.col("s_suppkey").cast("string"), F.lit(".lnk")).alias("path"), F.lit(1).alias("src_prio"), F.col("s_suppkey").alias("ordinal"))
    links = s.select(F.concat(F.lit("c:\\l\\"), F.col("s_suppkey").cast("string"), F.lit(".LNK")).alias("path"), F.concat(F.lit("C:\\T\\"), (F.col("s_suppkey") % 40).cast("string"), F.lit(".exe")).alias("target"))
    return catalogue.discover(apps, links).select("name", "target")


#: Entries of six kinds around the same executables: by path, shortcut, ids with a path, in a known folder and without a path, and an id of no executable there.
_BRIDGED = r"""
with e as (
  select s_suppkey as k, s_suppkey % 6 as kind, s_suppkey // 12 as tool, s_suppkey // 6 % 2 as v,
    case when s_suppkey % 5 = 0 then 'TOOL ' || s_suppkey when s_suppkey % 6 = 0 then 'Tool' || s_suppkey // 12 else 'Tool ' || s_suppkey end as name from supplier),
t as (
  select *, case kind when 0 then 'd:\v' || v || '\tool' || tool || '.exe' when 1 then 'd:\v' || v || '\tool' || tool || '.exe' when 3 then 'd:\v' || v || '\tool' || tool || '.exe'
    when 4 then 'c:\windows\system32\tool' || tool || '.exe' end as target, case kind when 2 then 'tool' || tool || '.exe' when 5 then 'other' || tool || '.exe' end as store from e),
f as (select split_part(target, '\', -1) as file, min_by(target, k) as joined from t where target is not null group by 1),
g as (
  select t.*, coalesce(target, joined, store) as key,
    case when regexp_matches(name, '[a-z]') then 4 else -4 end - length(name) // 8 + case when kind = 3 then 2 else 0 end
      + case when target is null then 0 when lower(replace(name, ' ', '')) || '.exe' = split_part(target, '\', -1) then -8 when contains(name, ' ') then 3 else 0 end as score
  from t left join f on store = file)
select name, target, store as package_file from g qualify row_number() over (partition by key order by score desc, k) = 1
"""


@registered(_BRIDGED)
def target_graph(spark, d):
    """Entries that stand for one executable, some of them only through the file name in a Store id."""
    s = read(spark, d, "supplier")
    key, kind = F.col("s_suppkey"), F.col("s_suppkey") % 6
    tool, text = F.concat(F.lit("TOOL"), F.floor(key / 12).cast("string")), key.cast("string")
    at = F.concat(F.lit("D:\\V"), (F.floor(key / 6) % 2).cast("string"))
    link = F.concat(F.lit("C:\\links\\"), text, F.lit(".lnk"))
    paths = [
        F.concat(at, F.lit("\\"), tool, F.lit(".EXE")),
        F.concat(F.lit("aumid:"), at, F.lit("/./"), tool, F.lit(".exe")),
        F.concat(F.lit("aumid:Vendor.Suite."), tool, F.lit(".EXE.15")),
        link,
        F.concat(F.lit("aumid:{1AC14E77-02E7-4E5D-B744-2EB1AE5198B7}\\"), tool, F.lit(".exe")),
        F.concat(F.lit("aumid:Other"), F.floor(key / 12).cast("string"), F.lit(".exe.1_x!App")),
    ]
    name = F.when(key % 5 == 0, F.concat(F.lit("TOOL "), text)).when(kind == 0, F.concat(F.lit("Tool"), F.floor(key / 12).cast("string"))).otherwise(F.concat(F.lit("Tool "), text))
    apps = s.select(name.alias("name"), F.coalesce(*[F.when(kind == k, p) for k, p in enumerate(paths)]).alias("path"), F.lit(1).alias("src_prio"), key.alias("ordinal"))
    links = s.where(kind == 3).select(F.upper(link).alias("path"), F.concat(at, F.lit("\\x\\..\\"), tool, F.lit(".exe")).alias("target"))
    return catalogue.one_of_target(catalogue.with_target(apps, links)).select("name", "target", "package_file")


_CODE = "list_sum([case when embedding[i] > 0 then 1::bigint << (i - 1) else 0 end for i in range(1, 25)])::bigint"


@registered(
    f"with w as (select label, {_CODE} as code, min(vec_id) as least, count(*) as n from embeddings group by 1, 2)"
    " select x.label, x.least as a, y.least as b, bit_count(xor(x.code, y.code))::int as distance from w x join w y on x.label = y.label and x.code < y.code and bit_count(xor(x.code, y.code)) <= 3"
)
def near_hashes(spark, d):
    """All vectors of one label whose first 24 signs differ in three at most."""
    rows = read(spark, d, "embeddings").select("vec_id", "label", F.get(X.sign_bits(F.slice("embedding", 1, 24)), F.lit(0)).alias("code"))
    return near.near_codes(rows, "code", "vec_id", "label", most=3, bits=24).withColumnRenamed("within", "label")


@registered("select p_partkey, case when p_partkey % 3 = 0 then 1 else 2 end as n, p_name || ' & <co>' as title, 'http://x/' || p_partkey as url, 'a ' || p_brand as snippet from part")
def rss_items(spark, d):
    """Feeds of two items, of which the second has no link in every third one."""
    name, key = F.col("p_name"), F.col("p_partkey").cast("string")
    item = lambda link: F.concat(F.lit("<item>\n<title> "), name, F.lit(" &amp; &lt;co&gt;</title><link>"), link, F.lit("</link><description>&lt;p&gt;a&lt;br&gt;"), F.col("p_brand"), F.lit("</description></item>"))
    body = F.concat(F.lit("<rss><title>feed</title>"), item(F.concat(F.lit("http://x/"), key)), item(F.when(F.col("p_partkey") % 3 == 0, " ").otherwise("http://y")), F.lit("</rss>"))
    first = F.get("items", F.lit(0))
    return read(spark, d, "part").select("p_partkey", X.rss_items(body).alias("items")).select("p_partkey", F.size("items").alias("n"), first["title"].alias("title"), first["url"].alias("url"), first["snippet"].alias("snippet"))


@registered("select p_partkey, case when p_partkey % 2 = 0 then 'u,t,n' else 't,n' end as urls, case when p_partkey % 2 = 0 then 'About' else substring(repeat(p_name || ' ', 20), 1, 110) end as title from part")
def answer_results(spark, d):
    """Answers with an abstract in every second one, a topic with a long text and a nested one."""
    topic = F.struct(F.expr("repeat(concat(p_name, ' '), 20)").alias("Text"), F.lit("t").alias("FirstURL"), F.array().cast("array<struct<Text: string, FirstURL: string>>").alias("Topics"))
    group = F.struct(F.lit(None).cast("string").alias("Text"), F.lit(None).cast("string").alias("FirstURL"), F.array(F.struct(F.lit("nested").alias("Text"), F.lit("n").alias("FirstURL"))).alias("Topics"))
    body = F.to_json(F.struct(F.lit("About").alias("Heading"), F.when(F.col("p_partkey") % 2 == 0, "abs").otherwise("").alias("AbstractText"), F.lit("u").alias("AbstractURL"), F.array(topic, group).alias("RelatedTopics")))
    rows = read(spark, d, "part").select("p_partkey", X.answer_results(body).alias("r"))
    return rows.select("p_partkey", F.array_join(F.transform("r", lambda r: r["url"]), ",").alias("urls"), F.get("r", F.lit(0))["title"].alias("title"))


_COMMAND_HEADS = ('"C:\\p q\\', "u", '"open ', "", '""', ' "', "  C:\\")
_COMMAND_TAILS = ('.exe"  /S x', ".exe /n ", "", '"', " ", '.exe" "a b"')


@registered(
    rf"""with commands as (select s_suppkey, ltrim({_pick_sql(_COMMAND_HEADS, "s_suppkey")} || s_name || {_pick_sql(_COMMAND_TAILS, f"s_suppkey / {len(_COMMAND_HEADS)}")}) as s from supplier),
    cut as (select s_suppkey, s, starts_with(s, '"') as quoted, strpos(s[2:], '"') as closes, strpos(s || ' ', ' ') as space from commands),
    parts as (select s_suppkey, case when not quoted then s[:space - 1] when closes > 0 then s[2:closes] else s[2:] end as exe, case when not quoted then ltrim(s[space:]) when closes > 0 then ltrim(s[closes + 2:]) else '' end as args from cut)
    select s_suppkey, nullif(exe, '') as exe, case when exe <> '' then args end as args from parts"""
)
def uninstall_command(spark, d):
    """Commands with quotes, without, with an open quote, and with nothing between quotes."""
    command = F.concat(_pick(_COMMAND_HEADS, F.col("s_suppkey")), F.col("s_name"), _pick(_COMMAND_TAILS, F.col("s_suppkey") / len(_COMMAND_HEADS)))
    return read(spark, d, "supplier").select("s_suppkey", X.uninstall_command(command).alias("c")).select("s_suppkey", "c.exe", "c.args")


_VALUE_TEXTS = ("%WinDir%\\", "%none%\\", "a%b", "%root%", "%ROOT%%windir%\\", "50%", "", "%WINDIR%%none%")


@registered(
    rf"""with texts as (select s_suppkey, {_pick_sql(_VALUE_TEXTS, "s_suppkey")} || s_name as text from supplier),
    known as (select s_suppkey, regexp_replace(regexp_replace(text, '%windir%', '%Root%w', 'gi'), '%root%', 'C:\\', 'gi') as text from texts)
    select s_suppkey, case when len(text) - len(replace(text, '%', '')) > 1 then text[:strpos(text, '%') - 1] || text[strpos(text, '%') + 1:] else text end as path from known"""
)
def expand_env(spark, d):
    """Values of values, unknown names, and single signs."""
    return read(spark, d, "supplier").select("s_suppkey", X.expand_env({"windir": "%Root%w", "ROOT": "C:\\"})(F.concat(_pick(_VALUE_TEXTS, F.col("s_suppkey")), "s_name")).alias("path"))


@registered("select p_partkey, upper(p_name[1]) || substring(split_part(p_name, ' ', 1), 2) || upper(split_part(p_name, ' ', 2)[1]) || substring(split_part(p_name, ' ', 2), 2) || chr(39) || 's' as shown from part")
def prettified(spark, d):
    return read(spark, d, "part").select("p_partkey", X.prettified(F.concat(F.replace("p_name", F.lit(" "), F.lit("_-")), F.lit("'s"))).alias("shown"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The tree's first page for a word, with paths."""
    return search.search_generic(placed(spark, d), "customer").select("file_ref", "name", "path", "rank")

"""File names, text and log parsing on the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from furrow.catalog.registry import APP_PREFIXES, epoch_micros, event_log, query, sql, table
from furrow.functions import text as X
from furrow.operators import telemetry as T
from furrow.session import new_folder, stored
from furrow.sources import files as S
from furrow.sources import logs as L
from furrow.sources import sinks as K


def _page_files(spark, sf) -> str:
    """Each page as a file of its own, every third one as text instead of HTML; returns the folder."""
    folder = new_folder(spark)
    ending = F.when(F.col("page_id") % 3 == 0, ".txt").otherwise(".html")
    path = F.concat(F.lit("/pages/page"), F.col("page_id").cast("string"), ending)
    S.write_files(table(spark, sf, "pages").select(path.alias("path"), F.col("html").cast("binary").alias("content")), folder).count()
    return folder


PAGE_FILES = "select 'page' || page_id || case when page_id % 3 = 0 then '.txt' else '.html' end as name, strlen(html) as length"


@query("s01_scanned_files", PAGE_FILES + ", sha256(html) as digest from pages")
def _(spark, sf):
    """A folder of files, written and scanned."""
    return S.scan(spark, _page_files(spark, sf)).select(X.base_name(F.col("path")).alias("name"), "length", F.sha2("content", 256).alias("digest"))


@query("s05_flat_listing", PAGE_FILES + " from pages where page_id % 3 <> 0")
def _(spark, sf):
    """The files of one extension; their contents are not read."""
    return S.scan(spark, _page_files(spark, sf), glob="*.html").select(X.base_name(F.col("path")).alias("name"), "length")


@query("k03_written_files", PAGE_FILES.replace("select", "select '/pages/page' || page_id || case when page_id % 3 = 0 then '.txt' else '.html' end as path,", 1).replace(
    "'page' || page_id || case when page_id % 3 = 0 then '.txt' else '.html' end as name, strlen(html) as length", "strlen(html) as bytes") + " from pages")
def _(spark, sf):
    """What writing one file per record reports."""
    path = F.concat(F.lit("/pages/page"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".txt").otherwise(".html"))
    rows = table(spark, sf, "pages").select(path.alias("path"), F.col("html").cast("binary").alias("content"))
    return stored(S.write_files(rows, new_folder(spark)))


@query("k01_one_text_file", "select l_returnflag as flag, count(*) as n, sum(l_quantity)::BIGINT as quantity from lineitem group by 1")
def _(spark, sf):
    """A small result as one text file, replacing an older one, read back."""
    folder = new_folder(spark)
    flags = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity")
    )
    K.one_text_file(flags.limit(1), folder)
    K.one_text_file(flags, folder)
    return spark.read.schema("flag STRING, n BIGINT, quantity BIGINT").csv(folder)


@query("k02_tab_separated", "select s_name as name, s_acctbal as value from supplier")
def _(spark, sf):
    """Names and values as tab-separated text, read back."""
    folder = new_folder(spark)
    K.tab_separated(table(spark, sf, "supplier").select("s_name", F.col("s_acctbal").cast("double").cast("string")), folder)
    return spark.read.schema("name STRING, value DOUBLE").option("sep", "\t").csv(folder)


@query("k06_reloaded_records", "select o_orderkey, o_custkey, o_totalprice from orders")
def _(spark, sf):
    """Processed records saved and loaded again."""
    folder = new_folder(spark)
    K.save_records(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), folder)
    return K.load_records(spark, folder)


# Extensions in turn: kept lower and upper case ones, and look-alikes that are not kept.
ENDINGS = [".jpg", ".tiff", ".tif", ".png", ".JPG", ".PNG", ".jpeg", ".Jpg", ".txt"]


def _tree(spark, sf) -> str:
    """Pages as files of a folder tree, every fifth one empty; returns the root."""
    root = new_folder(spark)
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), (F.col("page_id") % 9).cast("int"))
    path = F.concat(F.lit("/day-"), (F.col("page_id") % 7).cast("string"), F.lit("/cam/img"), F.col("page_id").cast("string"), ending)
    content = F.when(F.col("page_id") % 5 == 0, F.lit("")).otherwise(F.col("html")).cast("binary")
    S.write_files(table(spark, sf, "pages").select(path.alias("path"), content.alias("content")), root, tree=True).count()
    return root


@query("s04_collected_catalog", f"""select 'day-' || d || '_cam' || name as name, length, 'day-' || d as day from (select page_id % 7 as d,
    'img' || page_id || (({ENDINGS})[page_id % 9 + 1]) as name,
    case when page_id % 5 = 0 then 0 else strlen(html) end::BIGINT as length from pages where page_id % 9 < 6) where length > 0""")
def _(spark, sf):
    """A tree of files, walked."""
    found = S.collect_catalog(spark, _tree(spark, sf))
    return found.select("name", "length", F.element_at(F.split("path", "/"), -3).alias("day"))


@query("s06_datasets", """select 'day-' || (page_id % 7) as dataset, count(*) as files, sum(strlen(html))::BIGINT as bytes
    from pages where page_id % 7 <> 3 and page_id % 5 <> 0 group by 1""")
def _(spark, sf):
    """Several day folders in one read, one of them left out; empty files hold nothing to read."""
    rows = S.read_datasets(spark, _tree(spark, sf), "day-", ["day-3"])
    return rows.groupBy("dataset").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


@query("s07_packed_files", """select 'page' || page_id || '.png' as png_name, length(html)::INT as chars from pages""")
def _(spark, sf):
    """Many files packed into few, and unpacked."""
    target = new_folder(spark)
    S.pack(S.scan(spark, _page_files(spark, sf)), target)
    return S.unpack(spark, target).select("png_name", F.length(F.col("content").cast("string")).alias("chars"))


@query("s07_unpacked_bundle", """select url as name, regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', '') || '.png' as png_name,
    length(html)::INT as chars from pages where page_id % 7 <> 0 and page_id % 11 <> 0""")
def _(spark, sf):
    p = F.col("page_id")
    packed = table(spark, sf, "pages").select(
        F.when(p % 7 != 0, F.col("url")).alias("name"), F.when(p % 11 != 0, F.col("html").cast("binary")).alias("content")
    )
    return S.unpack_of(packed).select("name", "png_name", F.length(F.col("content").cast("string")).alias("chars"))


@query("s09_event_lines", sql("select app, event, ts_ms, event_id from ev where event <> 'SparkListenerJobStart'", "ev"))
def _(spark, sf):
    """Events as log lines; the job-start lines are cut in the middle and must vanish."""
    log = event_log(spark, sf)
    line = F.to_json(F.struct(F.col("event").alias("Event"), F.col("ts_ms").alias("Timestamp"), F.col("app").alias("App Name")))
    cut = F.when(F.col("event") == "SparkListenerJobStart", F.substring(line, 1, 20)).otherwise(line)
    return L.event_lines(log.select("app", "event_id", cut.alias("value"))).select("app", "event", "ts_ms", "event_id")


@query("s09_event_folder", sql("select app, event, ts_ms, row_number() over (partition by app order by ts_ms, event_id) - 1 as line, 3::BIGINT as reads from ev", "ev"))
def _(spark, sf):
    """Log files of all apps, read with splits of three sizes: every line has the same number each time."""
    folder, reads = new_folder(spark), None
    L.write_event_logs(event_log(spark, sf), folder).count()
    for split in ("4k", "9k", spark.conf.get("spark.sql.files.maxPartitionBytes")):
        read = stored(L.event_log(spark, folder, split))
        reads = read if reads is None else reads.union(read)
    return reads.groupBy("app", "event", "ts_ms", F.col("event_id").alias("line")).agg(F.count("*").alias("reads"))


@query("k09_timing_records", sql("select app as job, waiting as read_s, execution as process_s, waiting + execution as total_s from jobsecs", "jobsecs"))
def _(spark, sf):
    """Timing rows of every job, added kind by kind and read back."""
    folder, times = new_folder(spark), T.job_times(event_log(spark, sf))
    record = times.select(F.col("app").alias("job"), F.col("waiting").alias("read_s"), F.col("execution").alias("process_s"))
    record = record.withColumn("total_s", F.col("read_s") + F.col("process_s"))
    for prefix in APP_PREFIXES:
        K.append_timing(record.where(F.col("job").startswith(prefix)), folder)
    return K.timings(spark, folder)


KINDS = {"signup": "cpu_idle", "view": "mem_free", "click": "cpu_user", "purchase": "bytes_in", "error": "load_one"}


@query("s10_long_metrics", f"""select floor(epoch_us(ts) / 3600000000)::BIGINT * 3600 as ts, 'node-' || (user_id % 11) as host,
    case event_type {" ".join(f"when '{k}' then '{v}'" for k, v in KINDS.items())} end as metric, round(sum(value), 6) as value from events group by all""")
def _(spark, sf):
    """A wide sheet with one row per hour and a column per host and event type, padded headers as exported."""
    e = table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts"))

    def cell(kind: str, host: int):
        pad = " " * (host % 3)
        value = F.when((F.col("event_type") == kind) & (F.col("user_id") % 11 == host), F.col("value"))
        return F.round(F.sum(value), 6).alias(f"{pad}node-{host} {KINDS[kind]}{pad}")

    wide = e.groupBy(F.date_format("hour", "yyyy-MM-dd'T'HH:mm:ssXXX").alias(" Timestamp")).agg(*[cell(k, h) for k in KINDS for h in range(11)])
    return L.long_metrics(wide).where(F.col("value").isNotNull())


@query("s13_logged_times", """select l_orderkey, l_linenumber, l_quantity as seconds from lineitem where l_returnflag <> 'N'""")
def _(spark, sf):
    quantity = F.col("l_quantity").cast("string")
    line = F.when(F.col("l_returnflag") == "N", F.concat(F.lit("Read "), quantity)).otherwise(
        F.concat(F.lit("Image proc. time: "), quantity, F.lit(" sec"))
    )
    return L.logged_times(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", line.alias("value")))


@query("s13_experiment_bounds", "select min(floor(epoch_us(ts) / 1000000))::BIGINT as start_s, max(floor(epoch_us(ts) / 1000000))::BIGINT as end_s from events")
def _(spark, sf):
    s = F.floor(epoch_micros(F.col("ts")) / F.lit(1000000)).cast("string")
    word = F.when(F.col("event_id") % 2 == 0, "start").otherwise("end")
    lines = table(spark, sf, "events").select(F.concat(F.lit("Experiment "), word, F.lit(" time: "), s, F.lit(" => Mon Jan 1")).alias("value"))
    both = lines.unionByName(table(spark, sf, "events").select(F.concat(
        F.lit("Experiment "), F.when(F.col("event_id") % 2 == 0, "end").otherwise("start"), F.lit(" time: "), s, F.lit(" => ")).alias("value")))
    return L.experiment_bounds(both)


@query("s14_node_metrics", """select event_id, floor(epoch_us(ts) / 1000)::BIGINT as ts, value as cpu, (user_id * 2)::DOUBLE as ram, 1::INT as disks from events""")
def _(spark, sf):
    ms = F.floor(epoch_micros(F.col("ts")) / F.lit(1000)).cast("long")
    sigar = F.create_map(F.lit("cpu"), F.col("value"), F.lit("ram"), (F.col("user_id") * 2).cast("double"))
    line = F.to_json(F.struct(ms.alias("timestamp"), F.struct(sigar.alias("sigar"), F.create_map(F.lit("disk0"), F.lit(1.5)).alias("filesystem")).alias("values")))
    rows = L.node_metric_lines(table(spark, sf, "events").select("event_id", line.alias("value")))
    return rows.select("event_id", "ts", F.col("sigar")["cpu"].alias("cpu"), F.col("sigar")["ram"].alias("ram"), F.size("filesystem").alias("disks"))


@query("p01_png_name", "select page_id, regexp_replace(split_part(url, '/', -1), '\\.[^.]*$', '') || '.png' as name from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.with_extension(F.col("url"), ".png").alias("name"))


@query("p06_job_code", sql("""select event_id, case when app like '%imageClustering%' then 'IC' when app like '%flowerCounter%' then 'FC'
    when app like '%imageRe%' then 'IR' end as code from ev""", "ev"))
def _(spark, sf):
    return event_log(spark, sf).select("event_id", X.job_code(F.col("app")).alias("code"))


@query("p07_slug", """select p_partkey, replace(replace(replace(lower(replace(title, ')', '')), ': ', '_'), ' (', '_'), ' ', '_') as slug from
    (select p_partkey, p_type || ': ' || p_name || ' (' || p_brand || ')' as title from part)""")
def _(spark, sf):
    title = F.concat("p_type", F.lit(": "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", X.slug(title).alias("slug"))


@query("p08_image_size", "select p_partkey, p_size as height, p_partkey::INT as width from part")
def _(spark, sf):
    size = X.image_size(F.concat(F.col("p_partkey").cast("string"), F.lit("x"), F.col("p_size").cast("string")))
    return table(spark, sf, "part").select("p_partkey", size[0].alias("height"), size[1].alias("width"))


@query("p09_run_name", "select page_id, 'flower_counter_' || translate(split_part(rtrim(url, '/'), '/', -1), '-.', '__') as name from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.run_name("flower_counter_", F.col("url")).alias("name"))

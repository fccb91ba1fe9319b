"""Every registered query of the engine by name, with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import FOLD_FROM, FOLD_TO, preview, usd, usd_sum
from .operators import catalogs, cleanup, document, family, ledger, matching, pricing, search, timeline, usage
from .sinks import archive, files
from .sources import bridge, databases, decoders, follow, jsonl, samples, zstd
from .storage import new_folder, once, settled
from .streaming import sessions as live

NOW, MIDDLE = 1706573100000, 1705276800000
TERMS, WITHOUT = ["ere", "ing"], ["casino"]


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return bridge.events(spark, d)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, "turned", f"{d}/events.parquet", lambda: ledger.turned(_raw(spark, d)))


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's priced steps: written once an application, as reports read them again and again."""
    found = lambda: once(spark, "found", f"{d}/events.parquet", lambda: ledger.steps(_events(spark, d)).withColumnRenamed("id", "event"))
    return once(spark, "steps", f"{d}/events.parquet", lambda: pricing.priced(found(), pricing.sample_catalog(spark)), version=repr(pricing.SAMPLE))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, "facts", f"{d}/events.parquet", lambda: usage.facts(_steps(spark, d), _events(spark, d)), version=repr(pricing.SAMPLE))


def _by(name: str, **how):
    return lambda spark, d: usage.report(_facts(spark, d), name, **how)


def _project(spark: SparkSession, d: str) -> DataFrame:
    roots = spark.createDataFrame([(f"/w/repo{n}",) for n in range(5)] + [("/w",)], "path string")
    return usage.report(_facts(spark, d), "project", roots=roots)


def _reported(spark: SparkSession, d: str) -> DataFrame:
    """Every ninth output stands for a call whose cost its harness reported; that comes before the catalog's."""
    found = _steps(spark, d).drop("model_key", "pico", "source", *[f"pico_{p}" for p in pricing.PARTS]).withColumn("reported", F.expr("if(output % 9 = 0, output / 1024D, null)"))
    rows = pricing.priced(found, pricing.sample_catalog(spark))
    return rows.groupBy("session", F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("steps"), F.count_if(F.col("pico").isNull()).alias("unpriced"), usd_sum("pico").alias("cost"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return usage.turn_totals(_steps(spark, d), ledger.prompts(_events(spark, d)))


def _family(spark: SparkSession, d: str) -> DataFrame:
    totals = _steps(spark, d).groupBy("session").agg(F.count("*").alias("steps"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("pico").alias("pico"))
    return family.totals(bridge.sessions(_raw(spark, d)), totals)


def _paged(spark: SparkSession, d: str) -> DataFrame:
    """The page before each session's newest event."""
    events = ledger.latest(_raw(spark, d)).select("session", "id", "seq", "kind")
    return timeline.page(events, 3, events.groupBy("session").agg(F.max("seq").alias("before")))


def _ordered(spark: SparkSession, d: str) -> DataFrame:
    """The first sessions of each sort, and days by their default one."""
    each = [usage.ordered(_facts(spark, d), "session", how, 7).withColumn("sort", F.lit(how)) for how in usage.SORTS] + [usage.ordered(_facts(spark, d), "day", limit=7).withColumn("sort", F.lit("day"))]
    rows = each[0]
    for more in each[1:]:
        rows = rows.unionByName(more)
    return rows.select("sort", "place", "key", "label", "sessions", "steps", "prompts", "input", "cost")


def _around(spark: SparkSession, d: str) -> DataFrame:
    events = ledger.latest(_raw(spark, d)).select("session", "id", "seq", "kind")
    anchors = events.where("kind <> 'system'").groupBy("session").agg(F.min_by("id", "seq").alias("id"))
    return timeline.around(events, anchors, 5)


def _docs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = bridge.table(spark, d, "documents").select(F.concat(F.lit("src:"), "source").alias("session"), F.col("doc_id").alias("event"), (F.lit(1704067200000) + F.col("doc_id") * 60000).alias("ts_ms"), "text")
    return docs, docs.groupBy("session").agg(F.max("ts_ms").alias("updated_at"))


def _search(spark: SparkSession, d: str) -> DataFrame:
    docs, sessions = _docs(spark, d)
    return search.search(docs, TERMS, WITHOUT, sessions, NOW)


def _asof(spark: SparkSession, d: str) -> DataFrame:
    """Line items as calls of the model that is their part's brand, priced by the library with segments that begin each year."""
    brands = bridge.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("model")).where("model is not null")
    years = "transform(sequence(1990, 2030), y -> named_struct('from', unix_date(make_date(y, 1, 1)) * 86400000L, 'input', cast(y % 7 + 1 as double), 'output', 0D, 'cache_read', 0D, 'cache_write', 0D, 'tiers', cast(array() as array<struct<above: bigint, input: double, output: double, cache_read: double, cache_write: double>>)))"
    offers = brands.select(F.col("model").alias("id")).distinct().select("id", F.expr(years).alias("prices"), F.lit(None).cast("bigint").alias("context_limit"))
    at = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint") * 86_400_000
    # Items of one model and day cost alike, so they are added up before they are priced.
    items = bridge.table(spark, d, "lineitem").select("l_partkey", "l_quantity", at.alias("ts_ms")).join(brands, F.col("l_partkey") == F.col("p_partkey"))
    zero = [F.lit(0).cast("bigint").alias(c) for c in ("output", "cache_read", "cache_write", "reasoning")]
    days = items.groupBy("model", "ts_ms").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("input")).select("model", "ts_ms", "n", "input", *zero)
    return pricing.priced(days, offers).groupBy("model").agg(F.sum("n").alias("n"), (usd_sum("pico") * 1e6).alias("cost"))


def _consensus(spark: SparkSession, d: str) -> DataFrame:
    offers = bridge.table(spark, d, "part").select(F.col("p_brand").alias("id"), F.expr("if(p_size % 5 = 0, 0.0, p_retailprice)").alias("input"), F.expr("if(p_size % 5 = 0, 0.0, p_size * 2.0)").alias("output"))
    return pricing.consensus(offers)


def _told(spark: SparkSession, d: str, harness: str) -> DataFrame:
    """The conversations as this harness writes them, read back by its decoder."""
    return decoders.DECODERS[harness](samples.lines(spark, d, harness))


def _decoded(harness: str):
    return lambda spark, d: _told(spark, d, harness).where("kind <> 'meta'").select(*SHOWN)


SHOWN = ("session", "id", "kind", "ts_ms", "text", "model", "call_id", "name", "is_error", "input", "output", "cache_read", "reasoning", "reported")


def _scanned(harness: str):
    """The conversations written down as files in the harness's layout, scanned and decoded."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        folder = new_folder(spark, harness)
        files.write(samples.files(spark, d, harness), folder)
        read = jsonl.whole if harness == "gemini" else jsonl.scan
        return jsonl.named(decoders.DECODERS[harness](read(spark, folder)), harness).where("kind <> 'meta'").select(*SHOWN)

    return run


def _stored(harness: str):
    """The conversations in databases of the harness's tables, read and decoded."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        folder = new_folder(spark, harness)
        files.write(samples.databases(spark, d, harness), folder)
        return databases.named(databases.DECODERS[harness](databases.scan(spark, folder, harness, piece=1 << 20))).where("kind <> 'meta'").select(*SHOWN)

    return run


def _framed(spark: SparkSession, d: str) -> DataFrame:
    """The conversations in files of zstd frames, read in small pieces and decoded."""
    folder = new_folder(spark, "zstd")
    files.write(samples.framed(samples.files(spark, d, "claude")), folder)
    return jsonl.named(decoders.claude(zstd.scan(spark, folder, piece=1 << 12)), "claude").where("kind <> 'meta'").select(*SHOWN).withColumn("session", F.regexp_replace("session", r"\.jsonl$", ""))


def _followed(spark: SparkSession, d: str) -> DataFrame:
    """Files that grow in three steps, cut anywhere, each followed by a stream to its end; what the stream kept is decoded."""
    folder = new_folder(spark, "follow")
    told = settled(samples.files(spark, d, "pi").withColumn("content", F.col("content").cast("binary")))
    for k in (1, 2, 3):
        files.write(told.select("path", F.expr(f"substring(content, 1, cast(length(content) * {k} div 3 as int))").alias("content")), f"{folder}/files")
        found = follow.stream(spark, f"{folder}/files", f"{folder}/manifests", piece=1 << 16)
        follow.keep(found, f"{folder}/kept", f"{folder}/checkpoint").awaitTermination()
    lines = follow.kept(spark, f"{folder}/kept").select(F.col("source").alias("session"), F.lit(None).cast("string").alias("parent"), "at", "line")
    return jsonl.named(decoders.pi(lines), "pi").where("kind <> 'meta'").select(*SHOWN)


STREAMED = ("session", "id", "seq", "ts_ms", "kind", "model", *ledger.TOKENS)


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """What the stateful ledger and status told of all deliveries, which arrive in three steps; each step goes on from the checkpoint."""

    def run() -> DataFrame:
        folder, rows = new_folder(spark, "stream"), settled(_raw(spark, d).select(*STREAMED))
        most = rows.where("seq < 1000000000").agg(F.max("seq")).first()[0] or 0
        for k in range(3):
            rows.where(F.least(F.lit(2), F.floor(F.col("seq") * 3 / (most + 1))) == k).write.mode("append").parquet(f"{folder}/in")
            changes = live.kept_up(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"))
            live.keep(changes, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
        return live.kept(spark, f"{folder}/out")

    return once(spark, "streamed", f"{d}/events.parquet", run)


def _children(spark: SparkSession, d: str) -> DataFrame:
    """Sessions below their parents; some name a call, some a call that their parent does not have."""
    events = _events(spark, d).where("first")
    calls = events.where("kind = 'tool_call'").select("session", "id", F.col("id").alias("call_id"), F.expr("if(seq % 3 = 0, 'Task', 'grep')").alias("name"), "ts_ms", "seq")
    first = calls.groupBy(F.col("session").alias("parent")).agg(F.min_by("call_id", "seq").alias("of"))
    own = bridge.sessions(_raw(spark, d)).where("parent is not null").join(first, "parent", "left")
    children = own.select(F.col("session").alias("child"), "parent", F.expr("case user_id % 7 when 0 then of when 1 then 'gone' end").alias("parent_call"), "started_at")
    return timeline.child_links(children, calls, timeline.step_times(_events(spark, d), calls.where("false").selectExpr("session", "id", "ts_ms as ended_at")))


def _told_calls(spark: SparkSession, d: str) -> DataFrame:
    return timeline.tool_results(ledger.latest(_told(spark, d, "claude").where("kind <> 'meta'").drop("parent", "cwd"))).drop("seq")


def _told_steps(spark: SparkSession, d: str) -> DataFrame:
    """Transcript lines to priced steps, end to end."""
    found = pricing.priced(ledger.steps(ledger.turned(_told(spark, d, "claude").where("kind <> 'meta'"))), pricing.sample_catalog(spark))
    return found.select("session", "id", "step_idx", "turn", "ts_ms", "model", "input", usd(F.col("pico")).alias("cost"))


def _document(spark: SparkSession, d: str) -> DataFrame:
    """Transcript lines to nested documents of turns, steps and items, shown item by item."""
    turned = settled(ledger.turned(_told(spark, d, "claude").where("kind <> 'meta'")))
    steps = pricing.priced(settled(ledger.steps(turned)), pricing.sample_catalog(spark))
    return document.flat(document.document(turned, steps))


def _two_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sessions whose deliveries stand in two files, by odd and even positions."""
    turned = settled(ledger.turned(_raw(spark, d).withColumn("source", F.concat(F.lit("f"), (F.col("seq") % 2).cast("string")))))
    steps, _ = ledger.combined(turned, settled(ledger.steps(turned)), ledger.prompts(turned))
    return steps.select("session", "source", F.col("id").alias("event"), "step_idx", "turn", "ts_ms", "input")


def _cleanup(spark: SparkSession, d: str) -> DataFrame:
    """Every session is asked for; users' files lie in a folder of their own, and some folders are another session's."""
    own = settled(bridge.sessions(_raw(spark, d)))
    status = timeline.status(ledger.latest(_raw(spark, d)), NOW).select("session", "status")
    sessions = own.join(status, "session", "left").select("session", "parent", "harness", F.col("cwd").alias("title"), "status", F.expr("if(user_id % 13 = 5, user_id, null)").alias("pid"), F.expr("n_events % 11 = 3").alias("archived"), F.expr("user_id % 17 <> 4").alias("supported"), F.expr("n_events % 7 <> 2").alias("source_exists"))
    root = F.concat(F.lit("/h/"), "harness", F.lit("/"), F.col("user_id").cast("string"), F.lit("/"))
    path = F.concat(root, F.when(F.col("n_events") % 5 == 0, F.lit("all")).otherwise(F.col("session")))
    targets = own.select("session", F.explode(F.array(F.struct(path.alias("path"), (F.col("n_events") * 100).alias("bytes")), F.struct(F.concat(path, F.lit("/deep")).alias("path"), F.lit(7).cast("bigint").alias("bytes")), F.struct(F.concat(path, F.lit(".side")).alias("path"), (F.col("n_events") % 10).alias("bytes")))).alias("t"), "user_id").select("session", "t.path", "t.bytes", F.expr("t.bytes <> 0").alias("exists"), F.expr("user_id % 19 <> 6").alias("inside_root"), F.expr("t.bytes = 3").alias("symlink"), F.expr("t.bytes = 4").alias("hardlink"))
    sources = own.select("session", F.concat(root, F.lit("all/"), "session", F.lit(".jsonl")).alias("path"))
    requested = own.select("session", F.lit(1).alias("place")).unionByName(own.where("n_events % 4 = 0").select(F.concat(F.lit("no:"), "session").alias("session"), F.lit(2).alias("place")))
    return cleanup.plan(requested, sessions, targets, sources).drop("title")


def _synced(spark: SparkSession, d: str) -> DataFrame:
    """A catalog of groups of customers, read each month: a group's price is its least order's. Every third month only the fallback has it; some months the primary can't be read, and some prices are zero."""
    orders = bridge.table(spark, d, "orders").select(F.expr("concat('c', o_custkey % 40)").alias("buyer"), F.expr("year(o_orderdate) * 12 + month(o_orderdate)").cast("bigint").alias("read"), F.floor("o_totalprice").alias("p"))
    price = F.expr("if(p % 7 = 0, 0D, p / 1000D)")
    seen = orders.groupBy("read", F.col("buyer").alias("key")).agg(F.min("p").alias("p")).withColumn("i", price)
    rates = F.expr(f"cast(named_struct('input', i, 'output', 2 * i, 'cache_read', null, 'cache_write', null, 'tiers', array()) as {catalogs.RATES})")
    observed = seen.select("read", "key", F.expr(f"if(read % 3 = 0, '{catalogs.FALLBACK}', '{catalogs.PRIMARY}')").alias("source"), rates.alias("rates"))
    reads = seen.select("read").distinct().select("read", (F.col("read") * 1000).alias("at"), F.expr("read % 3 <> 0 or read % 2 = 0").alias("primary_ok"))
    base = spark.createDataFrame([], f"key string, source string, prices {catalogs.SEGMENTS}, pending {catalogs.RATES}")
    found = catalogs.synced(base, observed, reads)
    last = F.element_at("prices", -1)
    return found.select("key", "owner", F.size("prices").cast("bigint").alias("segments"), last["from"].alias("since"), last["rates"]["input"].alias("input"), F.col("pending.input").alias("pending"), "added", "changed")


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Parts as price lists in both files: some brands are sold by a first-party vendor, most by resellers, some for nothing."""
    part = bridge.table(spark, d, "part").select("p_partkey", F.regexp_replace("p_brand", "Brand#", "b").alias("b"), "p_size", F.floor("p_retailprice").alias("r"))
    vendor = "if(p_partkey % 211 = 0, if(p_partkey % 2 = 0, 'openai', 'google'), concat('seller', p_size % 9))"
    raw = "concat(if(p_size % 3 = 0, 'x/', ''), 'm-', b, '.', p_size % 3, if(p_size % 5 = 0, '-free', ''))"
    cost = "named_struct('input', if(p_size % 5 = 0, 0D, cast(r as double)), 'output', if(p_size % 5 = 0, 0D, p_size * 2D), 'cache_read', if(p_size % 2 = 0, p_size / 4D, null))"
    one = part.select(F.expr(f"to_json(map({vendor}, named_struct('models', map({raw}, named_struct('cost', {cost}, 'limit', named_struct('context', p_size * 1000))))))").alias("text"))
    two = part.where("p_partkey % 3 = 0").select(F.expr("to_json(map(concat('k-', b, '.', p_size % 4), named_struct('litellm_provider', if(p_partkey % 2 = 0, 'gemini', 'openai'), 'input_cost_per_token', r / 1000000D, 'output_cost_per_token', p_size / 1000000D, 'max_input_tokens', p_partkey % 2)))").alias("text"))
    found = catalogs.filled(catalogs.merged(catalogs.by_provider(one), catalogs.by_token(two)))
    return found.where("consensus or source <> 'models.dev'").groupBy("key").agg(F.min("source").alias("source"), F.min("context_limit").alias("context_limit"), F.count("*").alias("n"), F.min("rates.input").alias("least"), F.min("rates.output").alias("output"), F.min("rates.cache_read").alias("cache_read")).where(F.expr("source = 'models.dev'")).select("key", "n", "context_limit", F.col("least").alias("input"), "output", "cache_read")


def _archived(spark: SparkSession, d: str) -> DataFrame:
    """Documents as events of sessions by source, some with a picture in them: written as archives and read back."""
    docs = bridge.table(spark, d, "documents")
    text = F.expr("if(doc_id % 5 = 0, concat(text, ' ', repeat(base64(unhex(sha2('Aa0', 256))), 8), ' end'), text)")
    events = docs.select(F.concat(F.lit("doc:"), (F.col("doc_id") % 50).cast("string")).alias("session"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("seq"), F.lit(0).cast("bigint").alias("ts_ms"), F.expr("if(doc_id % 3 = 0, 'tool_result', 'assistant_message')").alias("kind"), text.alias("text"))
    folder = new_folder(spark, "archive")
    archive.write(events.groupBy("session").agg(F.count("*").alias("n_events")), archive.compacted(events), folder)
    v = F.from_json("record", "id string, seq bigint, text string, truncated boolean")
    return archive.read(spark, folder).where("line > 0").select(v.alias("v")).select("v.id", "v.truncated", F.octet_length("v.text").cast("bigint").alias("n_bytes"), F.sha2("v.text", 256).alias("sha256"))


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    """Parts as names of models: each brand is a family with two versions, written in the ways that harnesses write them."""
    part = bridge.table(spark, d, "part").select("p_partkey", F.translate(F.regexp_replace("p_brand", "^.*#", ""), "0123456789", "abcdefghij").alias("b"))
    ways = "element_at(array(concat('shop/Fam', b, '-2[1m]'), concat('fam', b, '-4-20250101'), concat('cli-fam', b, '-4'), concat('fam', b, '-2-high'), concat('x fam', b, ' 4 preview'), concat('fam', b, '-7'), concat('fam', b, '-2-max'), concat('fam', b), concat('Team ', b, ' Two'), concat('zz-fam', b, '-9')), cast(p_partkey % 10 + 1 as int))"
    models = part.select(F.expr(ways).alias("model"))
    rates = F.expr(f"cast(named_struct('input', 1D, 'output', 2D, 'cache_read', 1D, 'cache_write', null, 'tiers', array()) as {catalogs.RATES})")
    versions = part.select("b").distinct().select("b", F.explode(F.array(F.lit("2"), F.lit("4"))).alias("v"))
    entries = versions.select(F.expr("concat('fam', b, '-', v)").alias("id"), F.lit("fam").alias("provider"), F.expr("if(v = '2', concat('Team ', upper(b), ' Two 1017'), null)").alias("name"), F.lit(False).alias("consensus"), rates.alias("rates"))
    return matching.resolved(models, entries)


QUERIES: dict = {
    "usage_by_harness": _by("harness"), "usage_by_model": _by("model"), "usage_by_cwd": _by("cwd"), "usage_by_session": _by("session"), "usage_by_project": _project,
    "usage_by_dir": _by("dir", under="/w/repo1"), "usage_by_day": _by("day"), "usage_by_hour": _by("hour", tz="+08:00"), "usage_by_weekday": _by("weekday", tz="America/New_York"), "usage_by_weekday_hour": _by("weekday_hour"),
    "usage_fold_other": lambda s, d: usage.folded(_facts(s, d), "session", 10),
    "usage_totals": lambda s, d: usage.summed(_facts(s, d)),
    "usage_model_window": lambda s, d: usage.report(usage.chosen(_facts(s, d), since=MIDDLE, model="model-a"), "day"),
    "usage_against_before": lambda s, d: usage.against_before(_facts(s, d), MIDDLE, NOW),
    "usage_share_of_day": lambda s, d: usage.share_of_day(_facts(s, d)),
    "session_steps": lambda s, d: _steps(s, d).select("session", "event", "step_idx", "turn", "ts_ms", "model", "model_key", "input", usd(F.col("pico")).alias("cost")),
    "session_totals": lambda s, d: usage.session_totals(_steps(s, d), pricing.sample_catalog(s)),
    "session_turns": _turns,
    "cost_parts": lambda s, d: _steps(s, d).groupBy("session", F.coalesce("source", F.lit("")).alias("source")).agg(*[usd_sum(f"pico_{p}").alias(f"cost_{p}") for p in pricing.PARTS]),
    "cost_reported": _reported,
    "models_seen": lambda s, d: usage.models_seen(_steps(s, d)),
    "turn_numbering": lambda s, d: _events(s, d).select("session", "seq", "id", "kind", "first", "turn", "fill"),
    "event_upsert": lambda s, d: ledger.latest(_raw(s, d)).select("session", "id", "seq", "kind", "input"),
    "price_asof": _asof,
    "price_consensus": _consensus,
    "family_totals": _family,
    "family_ancestors": lambda s, d: family.ancestors(bridge.sessions(_raw(s, d))),
    "status_effective": lambda s, d: timeline.status(ledger.latest(_raw(s, d)), NOW),
    "events_page": _paged,
    "events_oldest": lambda s, d: timeline.oldest(ledger.latest(_raw(s, d)).select("session", "id", "seq", "kind"), 2),
    "events_around": _around,
    "trajectory_items": lambda s, d: timeline.trajectory(_events(s, d)),
    "sessions_filtered": lambda s, d: bridge.sessions(_raw(s, d)).where(search.session_filter(harness=["Alpha", "beta"], inside="REPO1", since=MIDDLE)).select("session", "harness", "updated_at"),
    "sessions_not_filtered": lambda s, d: bridge.sessions(_raw(s, d)).where(search.session_filter(has_parent=True, starts="alpha:", negate=True)).select("session", "parent"),
    "fts_sessions": _search,
    "fts_page": lambda s, d: search.sessions_page(_search(s, d), _docs(s, d)[1], 3, 1),
    "fts_kinds": lambda s, d: search.search(_docs(s, d)[0].withColumn("kind", F.expr("element_at(array('user', 'assistant', 'tool'), cast(event % 3 + 1 as int))")), TERMS, WITHOUT, _docs(s, d)[1].where("session <> 'src:src3'"), NOW, kinds=["user", "tool"]),
    "usage_ordered": _ordered,
    "fts_scan": lambda s, d: search.scan(_docs(s, d)[0], ["qu", "LE"], 25),
    **{f"decode_{h}": _decoded(h) for h in decoders.DECODERS},
    **{f"scan_{h}": _scanned(h) for h in decoders.DECODERS},
    **{f"database_{h}": _stored(h) for h in databases.DECODERS},
    "scan_zstd_frames": _framed,
    "follow_appended": _followed,
    "stream_steps": lambda s, d: live.current(_streamed(s, d), "step").select("session", F.col("id").alias("event"), "step_idx", "turn", "ts_ms", "model", "input"),
    "stream_status": lambda s, d: live.current(_streamed(s, d), "status").select("session", "status", "since", "reason", "last"),
    "transcript_sessions": lambda s, d: jsonl.sessions(_told(s, d, "pi")),
    "transcript_steps": _told_steps,
    "ledger_two_sources": _two_sources,
    "cleanup_plan": _cleanup,
    "archive_compact": _archived,
    "model_resolution": _resolved,
    "catalog_sync": _synced,
    "catalog_listed": _listed,
    "trajectory_document": _document,
    "tool_results": _told_calls,
    "step_times": lambda s, d: timeline.step_times(_events(s, d), _events(s, d).where("false").selectExpr("session", "id", "ts_ms as ended_at")),
    "child_links": _children,
    "conversation_previews": lambda s, d: bridge.table(s, d, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("t")).select("conv_id", preview(F.col("t"), 160).alias("preview")),
}

_RAW = """
e0 AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS ts_ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
e1 AS (SELECT list_extract(['alpha', 'beta', 'gamma', 'delta'], user_id % 4 + 1) AS harness, * FROM e0),
e2 AS (SELECT harness || ':u' || user_id || '-w' || (ts_ms // 604800000) AS session, harness, user_id, '/w/repo' || (user_id % 5) || '/sub' || (user_id % 3) AS cwd, event_id AS seq, 'e' || event_id AS id, ts_ms,
  CASE event_type WHEN 'signup' THEN 'user_message' WHEN 'view' THEN 'tool_call' WHEN 'click' THEN 'assistant_message' WHEN 'purchase' THEN 'usage' ELSE CASE WHEN k % 2 = 0 THEN 'turn_end' ELSE 'system' END END AS kind,
  CASE WHEN event_type IN ('purchase', 'click') THEN CASE k % 6 WHEN 0 THEN 'model-a' WHEN 1 THEN 'vendor/model-a' WHEN 2 THEN 'model-b' WHEN 3 THEN 'model-b[1m]' WHEN 4 THEN 'model-x' END END AS model,
  CAST(floor(value * 10) AS BIGINT) AS input, k AS output, k * 50 AS cache_read, (event_id % 3) * k AS cache_write, k // 4 AS reasoning FROM e1),
raw AS (SELECT * FROM e2 UNION ALL SELECT * REPLACE (seq + 1000000000 AS seq, input + 1 AS input) FROM e2 WHERE seq % 17 = 0)"""
_LATEST = _RAW + """,
latest AS (SELECT session, id, min(seq) AS seq, arg_max(kind, seq) AS kind, arg_max(input, seq) AS input, arg_max(ts_ms, seq) AS ts_ms FROM raw GROUP BY session, id)"""
_TURNED = _RAW + """,
t0 AS (SELECT *, row_number() OVER (PARTITION BY session, id ORDER BY seq) = 1 AS first FROM raw),
t1 AS (SELECT *, kind IN ('user_message', 'turn_start') AND first AS opens FROM t0),
t2 AS (SELECT *, opens OR kind IN ('usage', 'assistant_message', 'reasoning', 'tool_call', 'tool_result', 'turn_end') AS relevant FROM t1),
t3 AS (SELECT *, last_value(CASE WHEN relevant THEN opens END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  last_value(CASE WHEN kind = 'assistant_message' THEN model END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fill FROM t2),
turned AS (SELECT *, CAST(sum(CASE WHEN opens AND NOT coalesce(prev, false) THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS turn FROM t3)"""
_BASE = "regexp_replace(regexp_replace({0}, '^.*/', ''), '\\[.*\\]$', '')"
_STEPS = _TURNED + f""",
s0 AS (SELECT session, id AS event, harness, cwd, user_id, min(seq) AS seq, arg_min(turn, seq) AS turn, arg_max(ts_ms, seq) AS ts_ms, arg_max(input, seq) AS input, arg_max(output, seq) AS output, arg_max(cache_read, seq) AS cache_read,
  arg_max(cache_write, seq) AS cache_write, arg_max(reasoning, seq) AS reasoning, coalesce(arg_max(model, seq) FILTER (WHERE model IS NOT NULL), nullif(arg_min(coalesce(fill, ''), seq), '')) AS model
  FROM turned WHERE kind = 'usage' GROUP BY session, id, harness, cwd, user_id),
s1 AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS step_idx, coalesce({_BASE.format('model')}, '') AS model_key, input + cache_read + cache_write AS prompt FROM s0),
steps AS (SELECT *, CASE WHEN model_key = 'model-b' THEN input * 1000000 + output * 5000000 + cache_read * 100000 + cache_write * 1250000
  WHEN model_key = 'model-a' AND ts_ms < {MIDDLE} THEN input * 3000000 + output * 15000000 + cache_read * 300000 + cache_write * 3750000
  WHEN model_key = 'model-a' AND prompt > 3000 THEN input * 6000000 + output * 30000000 + cache_read * 600000 + cache_write * 7500000
  WHEN model_key = 'model-a' THEN input * 4000000 + output * 20000000 + cache_read * 400000 + cache_write * 5000000 WHEN prompt + output + reasoning = 0 THEN 0 END AS pico FROM s1)"""
_SOURCE = "CASE WHEN model_key IN ('model-a', 'model-b') THEN 'catalog' ELSE '' END"
_USD = "CAST(sum(pico) AS DOUBLE) / 1e12"
_FACTS = _STEPS + f""",
turn_model AS (SELECT session, turn, arg_min(model_key, seq) AS m FROM steps GROUP BY session, turn),
final AS (SELECT session, arg_max(fill, seq) AS m FROM turned WHERE fill IS NOT NULL GROUP BY session),
facts AS (SELECT session, harness, cwd, ts_ms, model_key, 1 AS is_step, 0 AS is_prompt, input, output, cache_read, cache_write, reasoning, pico, CASE WHEN pico IS NULL THEN 1 ELSE 0 END AS unpriced FROM steps
  UNION ALL SELECT p.session, p.harness, p.cwd, p.ts_ms, coalesce(t.m, {_BASE.format('f.m')}, ''), 0, 1, 0, 0, 0, 0, 0, NULL, 0 FROM turned p LEFT JOIN turn_model t ON p.session = t.session AND p.turn = t.turn
  LEFT JOIN final f ON p.session = f.session WHERE p.kind = 'user_message' AND p.first)"""
_SUMS = "count(DISTINCT session) AS sessions, CAST(sum(is_step) AS BIGINT) AS steps, CAST(sum(is_prompt) AS BIGINT) AS prompts, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in usage.SUMS) + f", {_USD} AS cost" + ", CAST(sum(unpriced) AS BIGINT) AS unpriced"
_SESSIONS = _RAW + """,
ss AS (SELECT session, harness, user_id, cwd, min(ts_ms) AS started_at, max(ts_ms) AS updated_at FROM raw GROUP BY ALL),
sessions AS (SELECT a.*, b.session AS parent FROM ss a LEFT JOIN ss b ON b.session <> a.session AND b.session = list_extract(['alpha', 'beta', 'gamma', 'delta'], (a.user_id // 3) % 4 + 1) || ':u' || (a.user_id // 3) || '-w' || split_part(a.session, '-w', 2))"""
_PAIRS = """, pairs AS (SELECT session, parent AS ancestor, CAST(1 AS BIGINT) AS depth FROM sessions WHERE parent IS NOT NULL UNION ALL SELECT p.session, s.parent, p.depth + 1 FROM pairs p JOIN sessions s ON p.ancestor = s.session WHERE s.parent IS NOT NULL)"""


def _grouped(key: str, where: str = "TRUE") -> str:
    return f"WITH {_FACTS} SELECT {key} AS key, {_SUMS} FROM facts WHERE {where} GROUP BY 1"


def _wall(form: str, shift: int = 0) -> str:
    return f"strftime(make_timestamp(CAST((ts_ms + {shift}) * 1000 AS BIGINT)), '{form}')"


_TF = "len(list_filter(range(1, length(f) - {n} + 2), lambda i: substr(f, i, {n}) = '{t}'))"
_SCORE = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * ({_TF.format(n=len(t), t=t)} * 2.2) / ({_TF.format(n=len(t), t=t)} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i, t in enumerate(TERMS))
_DOCS = f"docs AS (SELECT 'src:' || source AS session, doc_id AS event, 1704067200000 + doc_id * 60000 AS ts_ms, text, translate(coalesce(text, ''), '{FOLD_FROM}', '{FOLD_TO}') AS f, greatest(length(text) - 2, 0) AS dl FROM documents)"

_STEP_TIMES = _TURNED + """, ti AS (SELECT session, kind, ts_ms, first_value(CASE WHEN kind = 'usage' THEN id END IGNORE NULLS) OVER (PARTITION BY session, turn ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS step FROM turned WHERE first),
ta AS (SELECT session, step AS id, max(ts_ms) AS last, count(*) AS items FROM ti WHERE kind IN ('assistant_message', 'tool_call', 'system') AND step IS NOT NULL GROUP BY ALL),
tu AS (SELECT session, id, min(seq) AS seq, arg_min(turn, seq) AS turn, arg_max(ts_ms, seq) AS ts_ms FROM turned WHERE kind = 'usage' GROUP BY ALL),
tb AS (SELECT session, turn, min(ts_ms) AS begun FROM turned WHERE first AND kind <> 'turn_end' GROUP BY ALL),
tj AS (SELECT tu.*, begun, coalesce(items, 0) AS items, greatest(ts_ms, coalesce(last, ts_ms)) AS ended_at FROM tu LEFT JOIN ta USING (session, id) LEFT JOIN tb USING (session, turn)),
st AS (SELECT session, id, turn, seq, least(coalesce(lag(ended_at) OVER (PARTITION BY session, turn ORDER BY seq), begun, ts_ms), ts_ms) AS started_at, ts_ms, ended_at, items FROM tj)"""


_CHILD_LINKS = "WITH RECURSIVE" + _STEP_TIMES + _SESSIONS[len(_RAW):] + """,
ca AS (SELECT session, id, seq, ts_ms, seq % 3 = 0 AS agent FROM turned WHERE first AND kind = 'tool_call'),
cf AS (SELECT session, arg_min(id, seq) AS of FROM ca GROUP BY 1),
ch AS (SELECT s.session AS child, s.parent, CASE user_id % 7 WHEN 0 THEN of WHEN 1 THEN 'gone' END AS parent_call, started_at FROM sessions s LEFT JOIN cf ON cf.session = s.parent WHERE s.parent IS NOT NULL),
cn AS (SELECT ch.*, ca.id AS named FROM ch LEFT JOIN ca ON ca.session = ch.parent AND ca.id = ch.parent_call),
co AS (SELECT *, row_number() OVER (PARTITION BY parent ORDER BY started_at, child) AS i FROM cn WHERE parent_call IS NULL),
cl AS (SELECT parent, CAST(0 AS BIGINT) AS i, '' AS child, '' AS near, coalesce(list(named) FILTER (WHERE named IS NOT NULL), []) AS claimed FROM cn GROUP BY parent UNION ALL
  SELECT parent, i, child, near, list_append(claimed, near) FROM (SELECT cl.parent, co.i, co.child, any_value(cl.claimed) AS claimed, arg_max(ca.id, ca.ts_ms * 10000000000::HUGEINT + ca.seq) AS near
  FROM cl JOIN co ON co.parent = cl.parent AND co.i = cl.i + 1 LEFT JOIN ca ON ca.session = co.parent AND ca.agent AND ca.ts_ms <= co.started_at AND NOT list_contains(cl.claimed, ca.id) GROUP BY ALL)),
cg AS (SELECT cn.child, cn.parent, cn.started_at, coalesce(named, near) AS call FROM cn LEFT JOIN cl ON cl.parent = cn.parent AND cl.child = cn.child)
SELECT cg.child, cg.parent, call, CASE WHEN call IS NULL THEN coalesce(arg_min(st.id, st.started_at) FILTER (WHERE cg.started_at <= st.ts_ms), arg_max(st.id, st.started_at)) END AS step
FROM cg LEFT JOIN st ON st.session = cg.parent AND st.started_at <= cg.started_at GROUP BY cg.child, cg.parent, call"""

_CONV = f"c AS (SELECT CAST(conv_id AS VARCHAR) AS session, conv_id, turn, role, text, {samples.AT} AS ts_ms, 'm' || turn AS m, 'c' || conv_id || '-' || turn AS call, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)"


def _told_sql(*parts: tuple[str, str, str, dict[str, str]]) -> str:
    """Events of conversations, each part (id, kind, condition, other columns)."""
    kinds = {"text": "VARCHAR", "model": "VARCHAR", "call_id": "VARCHAR", "name": "VARCHAR", "is_error": "BOOLEAN", "input": "BIGINT", "output": "BIGINT", "cache_read": "BIGINT", "reasoning": "BIGINT", "reported": "DOUBLE"}
    rows = (f"SELECT session, {id} AS id, '{kind}' AS kind, {more.get('ts_ms', 'ts_ms')} AS ts_ms, " + ", ".join(f"CAST({more.get(c, 'NULL')} AS {k}) AS {c}" for c, k in kinds.items()) + f" FROM c WHERE {where}" for id, kind, where, more in parts)
    return f"WITH {_CONV} " + " UNION ALL ".join(rows)


_TOLD = {
    "decode_claude": _told_sql(
        ("m", "system", "role = 'system'", {"name": "'notice'", "text": "text"}), ("m", "user_message", "role = 'user' AND turn % 4 < 2", {"text": "text"}), ("m || '#t'", "user_message", "role = 'user' AND turn % 4 >= 2 AND text <> ''", {"text": "text"}),
        ("m || '#0'", "tool_result", "role = 'user' AND turn % 4 >= 2", {"call_id": "'c' || conv_id || '-' || (turn - 1)", "text": "left(text, 20)", "is_error": "turn % 3 = 0"}),
        ("m || '#0'", "reasoning", "role = 'assistant'", {"text": "left(text, 10)"}), ("m || '#1'", "assistant_message", "role = 'assistant'", {"text": "text", "model": "'model-a'"}), ("m || '#2'", "tool_call", "role = 'assistant'", {"call_id": "call", "name": "'grep'"}),
        ("'a' || turn || ':usage'", "usage", "role = 'assistant'", {"model": "'model-a'", "input": "n", "output": "turn * 10", "cache_read": "conv_id", "reasoning": "0"}), ("'a' || turn || ':end'", "turn_end", "role = 'assistant' AND turn % 4 = 1", {"name": "'end_turn'"})),
    "decode_codex": _told_sql(
        ("m", "user_message", "role = 'user'", {"text": "text"}), ("m", "tool_call", "role = 'assistant' AND turn % 4 = 1", {"call_id": "call", "name": "'shell'"}),
        ("'@' || i", "usage", "role = 'assistant' AND turn % 4 <> 1 AND turn // 4 IS DISTINCT FROM (SELECT max(p.turn // 4) FROM c p WHERE p.session = c.session AND p.role = 'assistant' AND p.turn % 4 <> 1 AND p.turn < c.turn)",
         {"input": "greatest(n - turn, 0)", "output": "CASE WHEN turn > 5 THEN 5 + turn ELSE 5 END", "cache_read": "turn", "reasoning": "turn", "model": "(SELECT max('model-b') FROM c p WHERE p.session = c.session AND p.role = 'system' AND p.turn < c.turn)"})),
    "decode_gemini": _told_sql(
        ("m", "system", "role = 'system'", {"name": "'info'", "text": "text"}), ("m", "user_message", "role = 'user'", {"text": "CASE WHEN text = '' THEN '' ELSE left(text, 30) || chr(10) || right(text, 5) END"}), ("m || ':t0'", "reasoning", "role = 'assistant'", {"text": "'Plan' || chr(10) || left(text, 10)"}),
        ("m", "assistant_message", "role = 'assistant' AND turn % 4 <> 1 AND text <> ''", {"text": "text", "model": "'model-a'"}), ("m || ':end'", "turn_end", "role = 'assistant' AND turn % 4 <> 1 AND text <> ''", {"name": "'stop'"}),
        ("m || ':c0'", "tool_call", "role = 'assistant' AND turn % 4 = 1", {"call_id": "call", "name": "'ls'"}), ("m || ':r0'", "tool_result", "role = 'assistant' AND turn % 4 = 1", {"call_id": "call", "name": "'ls'", "text": "left(text, 15)", "is_error": "false"}),
        ("m || ':u'", "usage", "role = 'assistant'", {"model": "'model-a'", "input": "greatest(n + 2 - conv_id, 0)", "output": "7 + turn", "cache_read": "conv_id", "reasoning": "turn"})),
    "decode_pi": _told_sql(
        ("m", "user_message", "role = 'user' AND text <> ''", {"text": "text"}), ("m || '#0'", "assistant_message", "role = 'assistant'", {"text": "text", "model": "'model-a'"}), ("m || ':end'", "turn_end", "role = 'assistant'", {"name": "'stop'"}),
        ("m || ':usage'", "usage", "role = 'assistant'", {"model": "'model-a'", "input": "n", "output": "CASE WHEN turn < 3 THEN turn + 3 ELSE turn END", "cache_read": "0", "reasoning": "3", "reported": "CASE WHEN turn % 4 <> 1 AND n > 0 THEN n / 1024.0::DOUBLE END"})),
    "step_times": f"WITH {_STEP_TIMES} SELECT * FROM st",
    "child_links": _CHILD_LINKS,
    "tool_results": f"WITH {_CONV} SELECT a.session, a.m || '#2' AS id, a.call AS call_id, 'grep' AS name, a.ts_ms, r.ts_ms AS ended_at, r.turn % 3 = 0 AS is_error, left(r.text, 20) AS result, r.turn IS NULL AS running FROM c a LEFT JOIN c r ON a.session = r.session AND r.turn = a.turn + 1 AND r.role = 'user' AND r.turn % 4 >= 2 WHERE a.role = 'assistant'",
    "transcript_sessions": f"WITH {_CONV}, p AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, trim(regexp_replace(left(text, 200), '\\s+', ' ', 'g')) AS h FROM c), "
    "f AS (SELECT *, CASE WHEN length(t) > 160 THEN substr(t, 1, 160) || '…' ELSE t END AS short, CASE WHEN length(h) > 120 THEN substr(h, 1, 120) || '…' ELSE h END AS head FROM p) "
    "SELECT session, CAST(NULL AS VARCHAR) AS parent, max('/w') FILTER (WHERE role = 'system') AS cwd, max('model-a') FILTER (WHERE role = 'assistant') AS model, arg_max(head, turn) FILTER (WHERE role = 'system' AND head <> '') AS title, arg_min(short, turn) FILTER (WHERE role = 'user' AND short <> '') AS preview, "
    "coalesce(min(ts_ms) FILTER (WHERE role = 'system'), min(ts_ms) FILTER (WHERE role = 'assistant' OR role = 'user' AND text <> '')) AS started_at, max(ts_ms) FILTER (WHERE role = 'assistant' OR role = 'user' AND text <> '') AS updated_at, "
    "count(*) FILTER (WHERE role = 'user' AND text <> '') + 3 * count(*) FILTER (WHERE role = 'assistant') AS n_events FROM f GROUP BY 1",
    "transcript_steps": f"WITH {_CONV}, o AS (SELECT *, (role = 'user' AND (turn % 4 < 2 OR text <> '')) AS opens, (role = 'user' AND turn % 4 >= 2) AS result FROM c), "
    "k AS (SELECT *, lag(opens) OVER (PARTITION BY session ORDER BY turn) AS after FROM o WHERE role <> 'system'), t AS (SELECT *, sum(CASE WHEN opens AND (result OR NOT coalesce(after, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn) AS turns FROM k) "
    "SELECT session, 'a' || turn || ':usage' AS id, row_number() OVER (PARTITION BY session ORDER BY turn) AS step_idx, turns::BIGINT AS turn, ts_ms, 'model-a' AS model, n AS input, (n * 10 + turn * 500 + conv_id) * CASE WHEN ts_ms < 1705276800000 THEN 300000 WHEN n + conv_id > 3000 THEN 600000 ELSE 400000 END / 1e12 AS cost FROM t WHERE role = 'assistant'",
}

SQL: dict[str, str] = {
    "usage_by_harness": _grouped("harness"), "usage_by_model": _grouped("model_key"), "usage_by_cwd": _grouped("cwd"), "usage_by_session": _grouped("session"), "usage_by_project": _grouped("regexp_extract(cwd, '^(/w/[^/]+)', 1)"),
    "usage_by_dir": _grouped("cwd", "cwd LIKE '/w/repo1/%'"), "usage_by_day": _grouped(_wall("%Y-%m-%d")), "usage_by_hour": _grouped(_wall("%H", 28_800_000)), "usage_by_weekday": _grouped(f"CAST(isodow(CAST({_wall('%Y-%m-%d', -18_000_000)} AS DATE)) AS VARCHAR)"),
    "usage_by_weekday_hour": _grouped(f"CAST(isodow(CAST({_wall('%Y-%m-%d')} AS DATE)) AS VARCHAR) || '-' || {_wall('%H')}"),
    "usage_fold_other": f"WITH {_FACTS}, g AS (SELECT session AS key, sum(pico) AS c, sum(input + output + cache_read + cache_write) AS t FROM facts GROUP BY 1), top AS (SELECT key FROM g ORDER BY coalesce(c, 0) DESC, t DESC, key LIMIT 10) SELECT coalesce(top.key, '(other)') AS key, {_SUMS} FROM facts LEFT JOIN top ON facts.session = top.key GROUP BY 1",
    "usage_totals": f"WITH {_FACTS} SELECT {_SUMS} FROM facts",
    "usage_model_window": _grouped(_wall("%Y-%m-%d"), f"model_key = 'model-a' AND ts_ms >= {MIDDLE}"),
    "usage_against_before": f"WITH {_FACTS}, g AS (SELECT harness, CAST(sum(pico) FILTER (WHERE ts_ms >= {MIDDLE} AND ts_ms < {NOW}) AS DOUBLE) / 1e12 AS cost, CAST(sum(pico) FILTER (WHERE ts_ms >= {2 * MIDDLE - NOW} AND ts_ms < {MIDDLE}) AS DOUBLE) / 1e12 AS cost_before FROM facts GROUP BY 1) SELECT *, cost / {(NOW - MIDDLE) / 86_400_000!r}::DOUBLE AS daily_mean FROM g",
    "usage_share_of_day": f"WITH {_FACTS}, g AS (SELECT {_wall('%Y-%m-%d')} AS day, model_key, sum(pico) AS c FROM facts WHERE is_step = 1 GROUP BY ALL) SELECT day, model_key, CAST(c AS DOUBLE) / 1e12 AS cost, CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY day) AS DOUBLE) AS share FROM g",
    "session_steps": f"WITH {_STEPS} SELECT session, event, step_idx, turn, ts_ms, model, model_key, input, CAST(pico AS DOUBLE) / 1e12 AS cost FROM steps",
    "session_totals": f"WITH {_STEPS}, g AS (SELECT session, count(*) AS steps, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, {_USD} AS cost, arg_max(prompt, step_idx) AS context_tokens, arg_max(model_key, step_idx) AS last_model FROM steps GROUP BY 1), h AS (SELECT *, CAST(CASE last_model WHEN 'model-a' THEN 200000 WHEN 'model-b' THEN 100000 END AS BIGINT) AS context_limit FROM g) SELECT *, context_tokens * 100.0::DOUBLE / context_limit AS context_pct FROM h",
    "session_turns": f"WITH {_STEPS}, b AS (SELECT session, turn, ts_ms, 1 AS s, 0 AS p, input, output, pico FROM steps UNION ALL SELECT session, turn, ts_ms, 0, 1, 0, 0, NULL FROM turned WHERE kind = 'user_message' AND first) SELECT session, turn, min(ts_ms) AS started_at, CAST(sum(s) AS BIGINT) AS steps, CAST(sum(p) AS BIGINT) AS prompts, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output, {_USD} AS cost FROM b GROUP BY session, turn",
    "cost_parts": f"WITH {_STEPS}, c AS (SELECT *, {_SOURCE} AS source, CASE WHEN model_key = 'model-b' THEN 1 WHEN model_key <> 'model-a' THEN NULL WHEN ts_ms < {MIDDLE} THEN 3 WHEN prompt > 3000 THEN 6 ELSE 4 END AS i, CASE WHEN model_key = 'model-b' THEN 5 WHEN model_key <> 'model-a' THEN NULL WHEN ts_ms < {MIDDLE} THEN 15 WHEN prompt > 3000 THEN 30 ELSE 20 END AS o FROM steps) SELECT session, source, " + ", ".join(f"CAST(sum({c}) AS DOUBLE) / 1e12 AS cost_{n}" for n, c in (("input", "input * i * 1000000"), ("output", "output * o * 1000000"), ("cache_read", "cache_read * i * 100000"), ("cache_write", "cache_write * i * 1250000"))) + " FROM c GROUP BY 1, 2",
    "cost_reported": f"WITH {_STEPS}, c AS (SELECT session, CASE WHEN output % 9 = 0 AND output > 0 THEN 'harness' ELSE {_SOURCE} END AS source, CASE WHEN output % 9 = 0 AND output > 0 THEN output * 976562500 ELSE pico END AS pico FROM steps) SELECT session, source, count(*) AS steps, count(*) FILTER (WHERE pico IS NULL) AS unpriced, {_USD} AS cost FROM c GROUP BY 1, 2",
    "models_seen": f"WITH {_STEPS} SELECT coalesce(model, '') AS model, model_key, count(*) AS steps, count(DISTINCT session) AS sessions, {_USD} AS cost FROM steps GROUP BY 1, 2",
    "turn_numbering": f"WITH {_TURNED} SELECT session, seq, id, kind, first, turn, fill FROM turned",
    "event_upsert": f"WITH {_LATEST} SELECT session, id, seq, kind, input FROM latest",
    "price_asof": "SELECT p_brand AS model, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT) * (year(l_shipdate) % 7 + 1)) AS DOUBLE) * 1e6 / 1e12 * 1e6 AS cost FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "price_consensus": "WITH o AS (SELECT lower(p_brand) AS match_key, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_retailprice END AS i, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_size * 2.0::DOUBLE END AS o FROM part), k AS (SELECT *, max(CASE WHEN i > 0 OR o > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY match_key) AS any_paid FROM o) SELECT match_key, round(median(i), 6) AS input, round(median(o), 6) AS output, count(*) AS n_offers FROM k WHERE i > 0 OR o > 0 OR any_paid = 0 GROUP BY 1",
    "family_totals": f"WITH RECURSIVE {_STEPS}, {_SESSIONS.removeprefix(_RAW).lstrip(',')}{_PAIRS}, u AS (SELECT session, count(*) AS steps, sum(input) AS input, sum(output) AS output, sum(pico) AS pico FROM steps GROUP BY 1), b AS (SELECT ancestor AS root, session, 1 AS n FROM pairs UNION ALL SELECT DISTINCT ancestor, ancestor, 0 FROM pairs) SELECT root, CAST(sum(n) AS BIGINT) AS sessions, CAST(coalesce(sum(steps), 0) AS BIGINT) AS steps, CAST(coalesce(sum(input), 0) AS BIGINT) AS input, CAST(coalesce(sum(output), 0) AS BIGINT) AS output, {_USD} AS cost FROM b LEFT JOIN u ON b.session = u.session GROUP BY 1",
    "family_ancestors": f"WITH RECURSIVE {_SESSIONS}{_PAIRS} SELECT session, ancestor, depth FROM pairs",
    "status_effective": f"WITH {_LATEST}, a AS (SELECT *, CASE WHEN kind = 'turn_end' THEN 'idle' ELSE 'work' END AS s FROM latest WHERE kind NOT IN ('usage', 'system')), b AS (SELECT *, max(ts_ms) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, coalesce(lag(s) OVER (PARTITION BY session ORDER BY seq) <> s, true) AS flip FROM a), c AS (SELECT session, arg_max(s, seq) AS s, arg_max(kind, seq) AS reason, max(run) AS last, arg_max(run, seq) FILTER (WHERE flip) AS since FROM b GROUP BY 1), d AS (SELECT *, CASE WHEN reason = 'assistant_message' THEN 90000 ELSE 600000 END AS w FROM c), f AS (SELECT *, s = 'work' AND {NOW} - last > w AS over_ FROM d) SELECT session, CASE WHEN over_ THEN 'idle' ELSE s END AS status, CASE WHEN over_ THEN last + w ELSE since END AS since, CASE WHEN over_ THEN 'stale' ELSE reason END AS reason, last FROM f",
    "events_page": f"WITH {_LATEST}, r AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY session) AS n FROM latest WINDOW w AS (PARTITION BY session ORDER BY seq DESC)) SELECT session, id, seq, kind, CASE WHEN n > 4 THEN min(seq) OVER (PARTITION BY session) END AS next_before FROM r WHERE rn BETWEEN 2 AND 4",
    "events_oldest": f"WITH {_LATEST}, r AS (SELECT *, rank() OVER (PARTITION BY session ORDER BY seq) AS rk FROM latest) SELECT session, id, seq, kind FROM r WHERE rk <= 2",
    "events_around": f"WITH {_LATEST}, r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS rn, count(*) OVER (PARTITION BY session) AS n FROM latest), a AS (SELECT session, min(seq) AS seq FROM latest WHERE kind <> 'system' GROUP BY 1), p AS (SELECT r.session, rn, n, least(n - rn, 4 - least(2, rn - 1)) AS after FROM r JOIN a ON r.session = a.session AND r.seq = a.seq) SELECT r.session, r.id, r.seq, r.kind FROM r JOIN p ON r.session = p.session AND r.rn BETWEEN p.rn - least(p.rn - 1, 4 - after) AND p.rn + after",
    "trajectory_items": f"WITH {_TURNED}, a AS (SELECT *, first_value(CASE WHEN kind = 'usage' THEN id END IGNORE NULLS) OVER w AS step, first_value(CASE WHEN kind = 'usage' THEN ts_ms END IGNORE NULLS) OVER w AS step_ended_at FROM turned WHERE first WINDOW w AS (PARTITION BY session, turn ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT session, turn, seq, id, kind, step, step_ended_at FROM a WHERE kind <> 'usage'",
    "sessions_filtered": f"WITH {_SESSIONS} SELECT session, harness, updated_at FROM sessions WHERE harness IN ('alpha', 'beta') AND contains(lower(cwd), 'repo1') AND updated_at >= {MIDDLE}",
    "sessions_not_filtered": f"WITH {_SESSIONS} SELECT session, parent FROM sessions WHERE NOT (parent IS NOT NULL AND session LIKE 'alpha:%')",
    "fts_sessions": f"WITH {_DOCS}, st AS (SELECT count(*) AS n, avg(dl) AS avgdl, " + ", ".join(f"count(*) FILTER (WHERE contains(f, '{t}')) AS df{i}" for i, t in enumerate(TERMS)) + f" FROM docs), up AS (SELECT session, max(ts_ms) AS updated_at FROM docs GROUP BY 1), h AS (SELECT session, event, {_SCORE} AS b FROM docs, st WHERE " + " AND ".join(f"contains(f, '{t}')" for t in TERMS) + " AND NOT contains(f, 'casino')), r AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY b DESC, event DESC) AS rank FROM h) " + f"SELECT r.session, event, rank, round(b, 6) AS bm25, round(b * (1 + 1 / (1 + greatest(({NOW} - updated_at) / 86400000.0::DOUBLE, 0) / 30)), 6) AS score FROM r JOIN up ON r.session = up.session WHERE rank <= 3",
    "fts_scan": f"WITH {_DOCS} SELECT session, event, ts_ms FROM docs WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'qu') AND contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'le') ORDER BY ts_ms DESC, event DESC LIMIT 25",
    **_TOLD,
    **{f"scan_{h}": _TOLD[f"decode_{h}"] for h in decoders.DECODERS},
    "follow_appended": _TOLD["decode_pi"],
    "conversation_previews": "WITH t AS (SELECT conv_id, trim(regexp_replace(arg_min(text, turn), '\\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' GROUP BY 1) SELECT conv_id, CASE WHEN length(t) > 160 THEN substr(t, 1, 160) || '…' ELSE t END AS preview FROM t",
}

SQL["stream_steps"] = f"WITH {_STEPS} SELECT session, event, step_idx, turn, ts_ms, model, input FROM steps"
# Every delivery counts for the status, mended ones where they are mended; long after, all work is over.
SQL["stream_status"] = SQL["status_effective"].replace("FROM latest", "FROM raw").replace(str(NOW), "9000000000000")

# The sequences of devin's nodes: the visible chain has no second tries; where the leaf is unknown all nodes are shown.
_DONE = "(turn % 4 <> 3 OR turn % 5 = 4)"
_PID = "'p' || conv_id || '-' || turn || '{0}'"
_DEVIN = "conv_id % 10 <> 9"
SQL |= {
    "database_opencode": _told_sql(
        (_PID.format(0), "system", "role = 'system'", {"name": "'file'", "text": "left(text, 12)"}), (_PID.format(1), "user_message", "role = 'user'", {"text": "text"}), (_PID.format(3), "assistant_message", "role = 'assistant'", {"text": "text", "model": "'model-a'", "ts_ms": "ts_ms + 3"}), (_PID.format(2), "reasoning", "role = 'assistant'", {"text": "left(text, 10)", "ts_ms": "ts_ms + 1"}),
        (_PID.format(4), "tool_call", "role = 'assistant'", {"call_id": "call", "name": "'grep'"}), (_PID.format(4) + " || ':r'", "tool_result", "role = 'assistant' AND turn % 4 = 1", {"call_id": "call", "name": "'grep'", "text": "left(text, 15)", "is_error": "false", "ts_ms": "ts_ms + 9"}),
        (_PID.format(5), "usage", "role = 'assistant'", {"model": "'model-a'", "input": "n", "output": "CASE WHEN turn % 3 = 0 THEN 7 ELSE 7 + turn END", "cache_read": "conv_id", "reasoning": "turn", "reported": "CASE WHEN turn > 0 THEN turn / 8.0::DOUBLE END"}),
        ("'m' || conv_id || '-' || turn || ':err'", "system", "role = 'assistant' AND turn % 5 = 4", {"name": "'error'", "text": "'Busy: later'", "ts_ms": "CASE WHEN turn % 4 <> 3 THEN ts_ms + 500 ELSE ts_ms END"}),
        ("'m' || conv_id || '-' || turn || ':end'", "turn_end", f"role = 'assistant' AND {_DONE} AND (turn % 5 = 4 OR turn % 4 <> 1)", {"name": "CASE WHEN turn % 5 = 4 THEN 'error' ELSE 'stop' END", "ts_ms": "CASE WHEN turn % 4 <> 3 THEN ts_ms + 500 ELSE ts_ms END"})),
    "database_hermes": _told_sql(
        ("h", "user_message", "role = 'user' AND turn % 7 <> 6 AND regexp_matches(text, '\\S')", {"text": "text"}), ("h || ':r'", "reasoning", "role = 'assistant' AND turn % 7 <> 6 AND regexp_matches(left(text, 6), '\\S')", {"text": "left(text, 6)"}), ("h", "assistant_message", "role = 'assistant' AND turn % 7 <> 6 AND regexp_matches(text, '\\S')", {"text": "text"}),
        ("h || ':c0'", "tool_call", "role = 'assistant' AND turn % 7 <> 6 AND turn % 4 = 1", {"call_id": "call", "name": "'grep'"}), ("h || ':c1'", "tool_call", "role = 'assistant' AND turn % 7 <> 6 AND turn % 4 = 1", {"call_id": "h || ':c1'", "name": "'ls'"}),
        ("h || ':e'", "turn_end", "role = 'assistant' AND turn % 7 <> 6 AND turn % 4 <> 1", {"name": "'stop'"}), ("h", "tool_result", "role = 'system' AND turn % 7 <> 6", {"call_id": "'x'", "name": "'notes'", "text": "coalesce(text, '')", "is_error": "false"}),
        ("'session:usage'", "usage", "i = 1", {"model": "'model-h'", "input": "conv_id % 4", "output": "8", "cache_read": "0", "reasoning": "5", "reported": "0.5"})).replace("row_number()", "'m' || (conv_id * 100000 + turn * 10) AS h, row_number()"),
    "database_copilot": _told_sql(
        ("h", "user_message", "role = 'user' AND regexp_matches(text, '\\S')", {"text": "text"}), ("h || ':a'", "assistant_message", "role = 'user' AND turn % 4 <> 0", {"text": "'re ' || left(text, 10)"}), ("h || ':end'", "turn_end", "role = 'user'", {"name": "'completed'"})).replace("row_number()", "'t' || (conv_id * 100000 + turn * 10) AS h, row_number()"),
    "database_devin": _told_sql(
        ("'n' || turn", "user_message", f"{_DEVIN} AND role = 'user' AND regexp_matches(text, '\\S')", {"text": "text"}), ("'n' || turn || ':r'", "reasoning", f"{_DEVIN} AND role = 'assistant' AND regexp_matches(left(text, 8), '\\S')", {"text": "left(text, 8)"}), ("'n' || turn", "assistant_message", f"{_DEVIN} AND role = 'assistant' AND regexp_matches(text, '\\S')", {"text": "text", "model": "'model-d'"}),
        ("'n' || turn || ':c0'", "tool_call", f"{_DEVIN} AND role = 'assistant' AND turn % 4 = 1", {"call_id": "call", "name": "'grep'"}), ("'n' || turn || ':u'", "usage", f"{_DEVIN} AND role = 'assistant' AND n + turn > 0", {"input": "n", "output": "turn", "cache_read": "0", "reasoning": "0"}), ("'n' || turn || ':e'", "turn_end", f"{_DEVIN} AND role = 'assistant' AND turn % 4 <> 1", {"name": "'completed'"}),
        ("'n' || turn", "tool_result", f"{_DEVIN} AND role = 'system' AND turn % 2 = 1", {"call_id": "''", "text": "text", "is_error": "false"}), ("'n' || turn", "system", f"{_DEVIN} AND role = 'system' AND turn % 2 = 0 AND regexp_matches(text, '\\S')", {"name": "'system'", "text": "text"}),
        ("'n' || (turn + 1000)", "user_message", "conv_id % 10 = 8 AND role = 'user' AND turn % 3 = 0", {"text": "'again ' || text", "ts_ms": "ts_ms + 1000"})),
}

SQL["trajectory_document"] = f"""WITH {_CONV}, o AS (SELECT *, (role = 'user' AND (turn % 4 < 2 OR text <> '')) AS opens, (role = 'user' AND turn % 4 >= 2) AS result FROM c),
k AS (SELECT *, lag(opens) OVER (PARTITION BY session, role = 'system' ORDER BY turn) AS after FROM o),
t AS (SELECT *, sum(CASE WHEN role <> 'system' AND opens AND (result OR NOT coalesce(after, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY turn)::BIGINT AS turns FROM k),
s AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn) AS step FROM t WHERE role = 'assistant'),
i AS (SELECT t.session, t.turns, t.turn, x.k, x.kind, CASE WHEN t.role = 'system' THEN t.m ELSE t.m || '#' || x.k END AS event, t.ts_ms AS ts, CASE x.k WHEN 0 THEN least(t.n, 10) WHEN 1 THEN t.n END AS chars, CASE x.k WHEN 1 THEN left(t.text, 200) END AS preview, CASE WHEN x.k = 2 THEN 'grep' WHEN t.role = 'system' THEN 'notice' END AS name,
  CASE WHEN x.k = 2 THEN r.ts_ms END AS item_ended_at, CASE WHEN x.k = 2 AND r.turn IS NOT NULL THEN r.turn % 3 = 0 END AS is_error, CASE WHEN x.k = 2 THEN left(r.text, 20) END AS output_preview, CASE WHEN x.k = 2 THEN r.turn IS NULL END AS running,
  (SELECT min(s.turn) FROM s WHERE s.session = t.session AND s.turns = t.turns AND s.turn >= t.turn) AS used
  FROM t JOIN (VALUES ('assistant', 0, 'reasoning'), ('assistant', 1, 'assistant_message'), ('assistant', 2, 'tool_call'), ('system', 3, 'system')) x(role, k, kind) ON t.role = x.role
  LEFT JOIN c r ON r.session = t.session AND r.turn = t.turn + 1 AND r.role = 'user' AND r.turn % 4 >= 2 AND t.role = 'assistant'),
e AS (SELECT session, turns, used, max(greatest(ts, coalesce(item_ended_at, 0))) AS last, min(ts) AS hint FROM i GROUP BY ALL),
p AS (SELECT session, turns, arg_min(CASE WHEN result THEN m || '#t' ELSE m END, turn) AS prompt, min(ts_ms) AS at FROM t WHERE opens GROUP BY ALL),
h AS (SELECT e.session, e.turns, p.prompt, coalesce(p.at, min(hint)) AS started_at, max(last) AS last FROM e LEFT JOIN p ON p.session = e.session AND p.turns = e.turns GROUP BY e.session, e.turns, p.prompt, p.at),
z AS (SELECT s.session, s.turns, s.turn, s.step, s.ts_ms, least(coalesce(lag(e.last) OVER (PARTITION BY s.session, s.turns ORDER BY s.turn), h.started_at), s.ts_ms) AS step_started_at FROM s JOIN e ON e.session = s.session AND e.turns = s.turns AND e.used = s.turn JOIN h ON h.session = s.session AND h.turns = s.turns)
SELECT i.session, i.turns AS turn, h.prompt, h.started_at, greatest(h.started_at, h.last) AS ended_at, z.step, z.step_started_at, row_number() OVER (PARTITION BY i.session, i.turns, i.used ORDER BY i.turn, i.k) - 1 AS item_no, kind, event, ts, chars, preview, name, item_ended_at, is_error, output_preview, running
FROM i JOIN h ON h.session = i.session AND h.turns = i.turns LEFT JOIN z ON z.session = i.session AND z.turns = i.turns AND z.turn = i.used"""

# A ledger a file: the file's number is part of the session's name until the ledgers are brought together.
SQL["ledger_two_sources"] = "WITH " + _STEPS.replace("(ts_ms // 604800000) AS session", "(ts_ms // 604800000) || '|f' || (event_id % 2) AS session") + """,
q1 AS (SELECT session, max(turn) AS turns, arg_min(ts_ms, seq) FILTER (WHERE kind = 'user_message' AND first) AS b FROM turned GROUP BY 1),
q2 AS (SELECT session, arg_min(ts_ms, seq) AS a FROM steps GROUP BY 1),
q3 AS (SELECT q1.session, split_part(q1.session, '|', 1) AS s, turns, coalesce(a, b, 0) AS begun FROM q1 LEFT JOIN q2 ON q1.session = q2.session),
q4 AS (SELECT session, s, coalesce(sum(turns) OVER (PARTITION BY s ORDER BY begun, session ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, row_number() OVER (PARTITION BY s ORDER BY begun, session) AS part FROM q3)
SELECT q4.s AS session, split_part(steps.session, '|', 2) AS source, event, row_number() OVER (PARTITION BY q4.s ORDER BY ts_ms, part, seq) AS step_idx, CAST(turn + base AS BIGINT) AS turn, ts_ms, input FROM steps JOIN q4 ON steps.session = q4.session"""
SQL["cleanup_plan"] = "WITH RECURSIVE" + SQL["status_effective"].removeprefix("WITH").rsplit("SELECT session, CASE", 1)[0].rstrip() + """,
stat AS (SELECT session, CASE WHEN over_ THEN 'idle' ELSE s END AS status FROM f)""" + _SESSIONS[len(_RAW):] + """,
ev AS (SELECT session, count(DISTINCT id) AS n_events FROM raw GROUP BY 1),
se AS (SELECT s.session, s.parent, s.harness, s.user_id, stat.status, n_events, CASE WHEN s.user_id % 13 = 5 THEN s.user_id END AS pid, n_events % 11 = 3 AS archived, s.user_id % 17 <> 4 AS supported, n_events % 7 <> 2 AS source_exists, '/h/' || s.harness || '/' || s.user_id || '/' AS root FROM sessions s JOIN ev ON ev.session = s.session LEFT JOIN stat ON stat.session = s.session),
pa AS (SELECT *, root || CASE WHEN n_events % 5 = 0 THEN 'all' ELSE session END AS path FROM se),
tg AS (SELECT session, path, n_events * 100 AS bytes, user_id % 19 <> 6 AS inside FROM pa UNION ALL SELECT session, path || '/deep', 7, user_id % 19 <> 6 FROM pa UNION ALL SELECT session, path || '.side', n_events % 10, user_id % 19 <> 6 FROM pa WHERE n_events % 10 <> 0),
rq AS (SELECT session, 1 AS place FROM se UNION ALL SELECT 'no:' || session, 2 FROM se WHERE n_events % 4 = 0),
ro AS (SELECT rq.session, rq.place, se.harness, CASE WHEN se.session IS NULL THEN 'unknown_session' WHEN se.archived THEN 'archived' WHEN NOT p.archived THEN 'subagent' END AS early, CASE WHEN NOT p.archived AND NOT se.archived THEN se.parent END AS early_detail FROM rq LEFT JOIN se ON se.session = rq.session LEFT JOIN se p ON p.session = se.parent),
tr AS (SELECT session AS top, session, CAST(0 AS BIGINT) AS depth FROM ro WHERE early IS NULL UNION ALL SELECT tr.top, se.session, tr.depth + 1 FROM tr JOIN se ON se.parent = tr.session AND NOT se.archived),
wh AS (SELECT top, count(*) - 1 AS children, min(CASE WHEN why IS NOT NULL THEN {'depth': depth, 'session': session, 'why': why} END) AS s FROM (SELECT tr.*, CASE WHEN NOT supported THEN 'unsupported' WHEN status = 'work' THEN 'working' WHEN pid IS NOT NULL THEN 'live_process' WHEN NOT source_exists THEN 'source_missing' END AS why FROM tr JOIN se ON se.session = tr.session) GROUP BY 1),
mv AS (SELECT top, path, max(bytes) AS bytes, bool_and(inside) AS inside FROM tr JOIN tg ON tg.session = tr.session GROUP BY ALL),
mm AS (SELECT * FROM mv WHERE NOT EXISTS (SELECT 1 FROM mv o WHERE o.top = mv.top AND o.path <> mv.path AND starts_with(mv.path, o.path || '/'))),
pt AS (SELECT top, sum(bytes) AS bytes, min(CASE WHEN NOT inside THEN path END) AS outside, min(CASE WHEN bytes IN (3, 4) THEN {'path': path, 'why': CASE bytes WHEN 3 THEN 'symlink' ELSE 'hardlink' END} END) AS l FROM mm GROUP BY 1),
sh AS (SELECT mm.top, min(o.session) AS shared FROM mm JOIN se o ON starts_with(o.root || 'all/' || o.session || '.jsonl', mm.path || '/') WHERE NOT EXISTS (SELECT 1 FROM tr WHERE tr.top = mm.top AND tr.session = o.session) GROUP BY 1),
fi AS (SELECT ro.*, coalesce(wh.children, 0) AS children, coalesce(early, wh.s.why, CASE WHEN outside IS NOT NULL THEN 'outside_root' END, l.why, CASE WHEN shared IS NOT NULL THEN 'shared_target' END) AS reason, CASE WHEN early IS NOT NULL THEN early_detail WHEN wh.s IS NOT NULL THEN wh.s.session ELSE coalesce(outside, l.path, shared) END AS detail, coalesce(pt.bytes, 0) AS b FROM ro LEFT JOIN wh ON wh.top = ro.session LEFT JOIN pt ON pt.top = ro.session LEFT JOIN sh ON sh.top = ro.session)
SELECT session, place, harness, children, reason IS NULL AS eligible, reason, detail, CAST(CASE WHEN reason IS NULL THEN b ELSE 0 END AS BIGINT) AS bytes, CAST(ceil(CASE WHEN reason IS NULL THEN b ELSE 0 END / 10.0) AS BIGINT) AS archive_bytes FROM fi"""

SQL["catalog_sync"] = """WITH RECURSIVE p AS (SELECT 'c' || (o_custkey % 40) AS key, year(o_orderdate) * 12 + month(o_orderdate) AS r, min(CAST(floor(o_totalprice) AS BIGINT)) AS p FROM orders GROUP BY ALL),
o AS (SELECT key, r, CASE WHEN p % 7 = 0 THEN 0 ELSE p / 1000.0::DOUBLE END AS i, r % 3 <> 0 AS prim, row_number() OVER (PARTITION BY key ORDER BY r) AS n FROM p),
w AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS owner, CAST(0 AS BIGINT) AS segments, CAST(0 AS BIGINT) AS since, CAST(NULL AS DOUBLE) AS input, CAST(NULL AS DOUBLE) AS pending, CAST(NULL AS BIGINT) AS added, CAST(NULL AS BIGINT) AS changed FROM o
 UNION ALL SELECT key, n, CASE WHEN fresh THEN CASE WHEN prim THEN 'models.dev' ELSE 'litellm' END ELSE owner END, CASE WHEN fresh THEN 1 WHEN moved THEN segments + 1 ELSE segments END, CASE WHEN fresh THEN 0 WHEN moved THEN r * 1000 ELSE since END, CASE WHEN fresh THEN i WHEN moved THEN next ELSE input END,
  CASE WHEN skip OR fresh THEN pending WHEN same OR moved THEN NULL ELSE next END, CASE WHEN fresh THEN r * 1000 ELSE added END, CASE WHEN moved AND NOT fresh THEN r * 1000 ELSE changed END
 FROM (SELECT *, NOT skip AND owner IS NULL AS fresh, NOT skip AND owner IS NOT NULL AND NOT same AND (NOT far OR coalesce(pending = next, false)) AS moved FROM (SELECT w.key, o.n, w.owner, w.segments, w.since, w.input, w.pending, w.added, w.changed, o.r, o.i, o.prim, CASE WHEN o.i > 0 THEN o.i ELSE w.input END AS next,
   NOT o.prim AND NOT (o.r % 2 = 0) AND coalesce(w.owner = 'models.dev', false) AS skip, (CASE WHEN o.i > 0 THEN o.i ELSE w.input END) = w.input AS same, CASE WHEN w.input > 0 THEN abs((CASE WHEN o.i > 0 THEN o.i ELSE w.input END) - w.input) / w.input ELSE 1e9 END > 0.5 AS far FROM w JOIN o ON o.key = w.key AND o.n = w.n + 1)))
SELECT key, owner, segments, since, input, pending, added, changed FROM w WHERE n = (SELECT max(o.n) FROM o WHERE o.key = w.key) AND owner IS NOT NULL"""
SQL["catalog_listed"] = """WITH l AS (SELECT p_partkey, p_size, CAST(floor(p_retailprice) AS BIGINT) AS r, 'm-' || replace(p_brand, 'Brand#', 'b') || '.' || (p_size % 3) || CASE WHEN p_size % 5 = 0 THEN '-free' ELSE '' END AS id, p_partkey % 211 = 0 AS own FROM part),
k AS (SELECT *, lower(regexp_replace(id, '(\\d)\\.(\\d)', '\\1-\\2')) AS key FROM l), f AS (SELECT DISTINCT key FROM k WHERE own), t AS (SELECT * FROM k WHERE NOT own AND key NOT IN (SELECT key FROM f)),
a AS (SELECT key, median(p_size * 1000) AS c, median(r) AS i, median(p_size * 2.0::DOUBLE) AS o, median(p_size / 4.0::DOUBLE) FILTER (WHERE p_size % 2 = 0) AS cr FROM t WHERE p_size % 5 <> 0 GROUP BY 1),
z AS (SELECT DISTINCT key FROM t WHERE p_size % 5 = 0 AND replace(key, '-free', '') NOT IN (SELECT key FROM f UNION SELECT key FROM a))
SELECT key, CAST(1 AS BIGINT) AS n, CAST(round(c) AS BIGINT) AS context_limit, CAST(i AS DOUBLE) AS input, o AS output, CAST(coalesce(round(cr, 6), i) AS DOUBLE) AS cache_read FROM a UNION ALL SELECT key, 1, NULL, 0, 0, 0 FROM z"""

_CUT = "CASE WHEN octet_length(encode(t)) <= most THEN t ELSE coalesce(" + ", ".join(f"try(decode(encode(t)[1:most - {k}]))" for k in range(4)) + ") END"
SQL["archive_compact"] = f"""WITH e AS (SELECT doc_id, doc_id % 5 = 0 AS pic, CASE WHEN doc_id % 3 = 0 THEN 2048 ELSE 16384 END AS most, CASE WHEN doc_id % 5 = 0 THEN text || ' [binary omitted: 352 bytes] end' ELSE text END AS t FROM documents),
c AS (SELECT *, {_CUT} AS cut FROM e) SELECT 'd' || doc_id AS id, pic OR cut <> t AS truncated, octet_length(encode(cut)) AS n_bytes, sha256(cut) AS sha256 FROM c"""
SQL["scan_zstd_frames"] = _TOLD["decode_claude"]

SQL["fts_page"] = f"WITH f AS ({SQL['fts_sessions']}), up AS (SELECT 'src:' || source AS session, 1704067200000 + max(doc_id) * 60000 AS updated_at FROM documents GROUP BY source), g AS (SELECT f.session, max(score) AS score, count(*) AS hits, any_value(updated_at) AS updated_at FROM f JOIN up ON up.session = f.session GROUP BY 1) SELECT row_number() OVER (ORDER BY score DESC, updated_at DESC, session) AS place, session, score, hits FROM g QUALIFY place BETWEEN 2 AND 4"
SQL["fts_kinds"] = SQL["fts_sessions"].replace("AND NOT contains(f, 'casino')", "AND NOT contains(f, 'casino') AND event % 3 <> 1 AND session <> 'src:src3'")


def _first(sort: str, key: str, order: str) -> str:
    return f"SELECT '{sort}' AS sort, place, CASE WHEN place < 8 THEN any_value(k) ELSE '(other)' END AS key, CASE WHEN place < 8 THEN any_value(k) ELSE count(DISTINCT k) || ' more' END AS label, count(DISTINCT session) AS sessions, CAST(sum(is_step) AS BIGINT) AS steps, CAST(sum(is_prompt) AS BIGINT) AS prompts, CAST(sum(input) AS BIGINT) AS input, {_USD} AS cost FROM (SELECT facts.*, {key} AS k, least(8, p) AS place FROM facts JOIN (SELECT {key} AS kk, row_number() OVER (ORDER BY {order}{key}) AS p FROM facts GROUP BY 1) ON kk = {key}) GROUP BY place"


_TOKENS = "sum(input + output + cache_read + cache_write) DESC, "
_ORDERS = {"auto": "coalesce(sum(pico), 0) DESC, " + _TOKENS, "cost": "coalesce(sum(pico), 0) DESC, " + _TOKENS, "tokens": _TOKENS, "steps": "sum(is_step) DESC, ", "sessions": "count(DISTINCT session) DESC, ", "prompts": "sum(is_prompt) DESC, ", "key": ""}
SQL["usage_ordered"] = f"WITH {_FACTS} " + " UNION ALL ".join([*[_first(s, "session", o) for s, o in _ORDERS.items()], _first("day", _wall("%Y-%m-%d"), "")])
SQL["model_resolution"] = """WITH p AS (SELECT DISTINCT p_partkey % 10 AS w, translate(regexp_replace(p_brand, '^.*#', ''), '0123456789', 'abcdefghij') AS b FROM part)
SELECT CASE w WHEN 0 THEN 'shop/Fam' || b || '-2[1m]' WHEN 1 THEN 'fam' || b || '-4-20250101' WHEN 2 THEN 'cli-fam' || b || '-4' WHEN 3 THEN 'fam' || b || '-2-high' WHEN 4 THEN 'x fam' || b || ' 4 preview' WHEN 5 THEN 'fam' || b || '-7' WHEN 6 THEN 'fam' || b || '-2-max' WHEN 7 THEN 'fam' || b WHEN 8 THEN 'Team ' || b || ' Two' ELSE 'zz-fam' || b || '-9' END AS model,
CASE WHEN w IN (6, 7) THEN 'none' WHEN w IN (0, 1) THEN 'exact' ELSE 'approx' END AS match_kind, CASE WHEN w IN (6, 7) THEN NULL ELSE 'fam' || b || CASE WHEN w IN (0, 3, 8) THEN '-2' ELSE '-4' END END AS id FROM p"""

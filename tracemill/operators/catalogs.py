"""Price catalogs: the two public price files, filling what they leave out, and merging successive reads of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import match_key

# The vendors whose own price lists count, the vendors by the name that the file of rates by token gives them, and its kinds of models.
FIRST_PARTY = ("anthropic", "openai", "google", "minimax", "moonshotai", "zai", "deepseek", "alibaba", "xai", "groq", "xiaomi", "meta", "stepfun", "mistral", "cohere", "perplexity")
BY_TOKEN = {"anthropic": "anthropic", "openai": "openai", "gemini": "google", "minimax": "minimax", "moonshot": "moonshotai", "zai": "zai", "deepseek": "deepseek", "dashscope": "alibaba", "xai": "xai", "groq": "groq"}
MODES = ("chat", "responses", "completion")
PRIMARY, FALLBACK = "models.dev", "litellm"
#: A price that moves by more than this share counts when it is seen twice.
CONFIRM = 0.5

_NUMBERS = "input double, output double, cache_read double, cache_write double"
_RATE = "input: double, output: double, cache_read: double, cache_write: double"
RATES = f"struct<{_RATE}, tiers: array<struct<above: bigint, {_RATE}>>>"
COST = f"struct<{_RATE}, tiers: array<struct<tier: struct<type: string, size: bigint>, {_RATE}>>, context_over_200k: struct<{_RATE}>>"
FILE = f"map<string, struct<models: map<string, struct<cost: {COST}, limit: struct<context: bigint, output: bigint>, name: string>>>>"
ENTRY = ("id", "key", "provider", "source", "name", "consensus", "context_limit", "output_limit", "rates")


def _n(c: str) -> str:
    """SQL for a price, null unless it is a finite number of 0 or more."""
    return f"if({c} >= 0 and {c} < double('Infinity'), {c}, null)"


def _rate(c: str, more: str = "") -> str:
    return f"named_struct({more}" + ", ".join(f"'{k}', {_n(f'{c}.{k}')}" for k in ("input", "output", "cache_read", "cache_write"))


def by_provider(documents: DataFrame) -> DataFrame:
    """Entries (ENTRY) of files (text) of providers' price lists, in USD per million tokens.

    The list price of a vendor in FIRST_PARTY counts, the first vendor's of those that list a name; other names have the
    median of what all others ask, each price by itself, spelt as most spell it. A free tier takes part in no median; one
    that costs nothing and has no paid sibling anywhere is an entry without costs. A missing cache price stays null.
    """
    listed = documents.select(F.explode(F.from_json("text", FILE)).alias("provider", "p")).select("provider", F.explode("p.models").alias("raw", "m"))
    tiers = f"transform(filter(coalesce(m.cost.tiers, array()), t -> t.tier.type = 'context' and t.tier.size is not null and {_n('t.input')} is not null and {_n('t.output')} is not null), t -> {_rate('t', more=repr('above') + ', t.tier.size, ')}))"
    over = f"if({_n('m.cost.context_over_200k.input')} is not null and {_n('m.cost.context_over_200k.output')} is not null, array({_rate('m.cost.context_over_200k', more=repr('above') + ', 200000L, ')})), array())"
    limit = lambda k: F.expr(f"if(m.limit.{k} > 0, m.limit.{k}, null)")
    rows = listed.select("provider", "raw", F.substring_index("raw", "/", -1).alias("id"), F.expr("m.name").alias("name"), limit("context").alias("context_limit"), limit("output").alias("output_limit"), F.expr(f"{_rate('m.cost')}, 'tiers', array_sort(if(size({tiers}) > 0, {tiers}, {over})))").cast(RATES).alias("rates"))
    rows = rows.where("rates.input is not null and rates.output is not null").withColumn("key", match_key(F.col("id")))
    place = F.array_position(F.array(*map(F.lit, FIRST_PARTY)), F.col("provider"))
    own = rows.withColumn("place", place).where("place > 0").withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("place", "raw", F.to_json("rates")))).where("n = 1")
    first = own.select("id", "key", "provider", F.lit(PRIMARY).alias("source"), "name", F.lit(False).alias("consensus"), "context_limit", "output_limit", "rates")
    others = rows.where(place == 0).join(own.select("key"), "key", "left_anti").withColumn("paid", F.nullif(F.regexp_extract("id", "^(.*)[:-]free$", 1), F.lit(""))).withColumn("vendor", F.expr("if(instr(raw, '/') > 0, regexp_extract(raw, '^(.*)/', 1), null)"))
    asked = others.where("paid is null and rates.input > 0 and rates.output > 0")

    def middle(c: str) -> F.Column:
        return F.when(F.count(c) % 2 == 1, F.median(c)).otherwise(F.round(F.median(c), 6))

    rates = F.struct(*[middle(f"rates.{k}").alias(k) for k in ("input", "output", "cache_read", "cache_write")], F.array().alias("tiers")).cast(RATES)
    agreed = asked.groupBy("key").agg(F.mode("id", True).alias("id"), F.coalesce(F.mode("vendor", True), F.lit("")).alias("provider"), F.round(F.median("context_limit")).cast("bigint").alias("context_limit"), F.round(F.median("output_limit")).cast("bigint").alias("output_limit"), rates.alias("rates"))
    agreed = agreed.select("id", "key", "provider", F.lit(PRIMARY).alias("source"), F.lit(None).cast("string").alias("name"), F.lit(True).alias("consensus"), "context_limit", "output_limit", "rates")
    free = others.where("paid is not null and rates.input = 0 and rates.output = 0").groupBy("key").agg(F.min_by(F.struct("id", "paid", "vendor"), F.struct("provider", "raw")).alias("f")).withColumn("sibling", match_key(F.col("f.paid")))
    known = first.select("key").unionByName(agreed.select("key")).withColumnRenamed("key", "sibling")
    nothing = F.expr(f"named_struct('input', 0D, 'output', 0D, 'cache_read', 0D, 'cache_write', cast(null as double), 'tiers', cast(array() as array<struct<above: bigint, {_RATE}>>))")
    alone = free.join(known, "sibling", "left_anti").select(F.col("f.id").alias("id"), "key", F.coalesce("f.vendor", F.lit("")).alias("provider"), F.lit(PRIMARY).alias("source"), F.lit(None).cast("string").alias("name"), F.lit(True).alias("consensus"), F.lit(None).cast("bigint").alias("context_limit"), F.lit(None).cast("bigint").alias("output_limit"), nothing.alias("rates"))
    return first.unionByName(agreed).unionByName(alone)


def by_token(documents: DataFrame) -> DataFrame:
    """Entries (ENTRY) of files (text) of models with their rates by token; of one name the bare spelling of the first vendor."""
    rows = documents.select(F.explode(F.from_json("text", "map<string, map<string, string>>")).alias("raw", "m"))
    names = F.create_map(*[F.lit(x) for pair in BY_TOKEN.items() for x in pair])
    rows = rows.withColumn("lp", F.expr("m['litellm_provider']")).withColumn("place", F.array_position(F.array(*map(F.lit, BY_TOKEN)), F.col("lp"))).where("place > 0").where(F.expr("m['mode'] is null") | F.expr("m['mode']").isin(*MODES))
    per = lambda k: f"round({_n(f'try_cast(m[{k}] as double)')} * 1e6, 6)"
    q = lambda k: f"'{k}'"
    sizes = "transform(filter(map_keys(m), k -> k rlike '^input_cost_per_token_above_[0-9]+k_tokens$'), k -> regexp_extract(k, '_([0-9]+)k_tokens$', 1))"
    tier = ", ".join(f"'{name}', {per('concat(' + q(of + '_above_') + ', n, ' + q('k_tokens') + ')')}" for name, of in (("input", "input_cost_per_token"), ("output", "output_cost_per_token"), ("cache_read", "cache_read_input_token_cost"), ("cache_write", "cache_creation_input_token_cost")))
    tiers = f"array_sort(filter(transform({sizes}, n -> named_struct('above', cast(n as bigint) * 1000, {tier})), t -> t.input is not null and t.output is not null))"
    rates = f"named_struct('input', {per(q('input_cost_per_token'))}, 'output', {per(q('output_cost_per_token'))}, 'cache_read', {per(q('cache_read_input_token_cost'))}, 'cache_write', {per(q('cache_creation_input_token_cost'))}, 'tiers', {tiers})"
    limit = lambda k: F.expr(f"if(try_cast(m['{k}'] as bigint) > 0, try_cast(m['{k}'] as bigint), null)")
    rows = rows.select("raw", "place", F.substring_index("raw", "/", -1).alias("id"), names[F.col("lp")].alias("provider"), limit("max_input_tokens").alias("context_limit"), limit("max_output_tokens").alias("output_limit"), F.expr(rates).cast(RATES).alias("rates")).where("rates.input is not null and rates.output is not null").withColumn("key", match_key(F.col("id")))
    order = Window.partitionBy("key").orderBy("place", F.contains("raw", F.lit("/")), "raw", F.to_json("rates"))
    first = rows.withColumn("n", F.row_number().over(order)).where("n = 1")
    return first.select("id", "key", "provider", F.lit(FALLBACK).alias("source"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("consensus"), "context_limit", "output_limit", "rates")


def merged(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """``primary`` and those entries of ``fallback`` whose names it does not have."""
    return primary.unionByName(fallback.join(primary.select("key"), "key", "left_anti").select(*primary.columns))


def _filled(r: str) -> str:
    """SQL for rates with their missing cache-read prices: the full input price; a tier's in the ratio of the base."""
    ratio = f"if({r}.input > 0, coalesce({r}.cache_read, {r}.input) / {r}.input, 1D)"
    tiers = f"transform({r}.tiers, t -> named_struct('above', t.above, 'input', t.input, 'output', t.output, 'cache_read', coalesce(t.cache_read, round(t.input * {ratio}, 6)), 'cache_write', t.cache_write))"
    return f"named_struct('input', {r}.input, 'output', {r}.output, 'cache_read', coalesce({r}.cache_read, {r}.input), 'cache_write', {r}.cache_write, 'tiers', {tiers})"


def filled(entries: DataFrame) -> DataFrame:
    return entries.withColumn("rates", F.expr(_filled("rates")).cast(RATES))


def _same(a: str, b: str) -> str:
    return f"(abs({a} - {b}) <= 1e-9 * greatest(abs({a}), abs({b}), 1D))"


def _same_rates(a: str, b: str) -> str:
    """SQL for whether two rates are alike; a missing cache-write price is like a missing one only."""
    one = lambda x, y: " and ".join([*[_same(f"{x}.{k}", f"{y}.{k}") for k in ("input", "output", "cache_read")], f"coalesce({_same(f'{x}.cache_write', f'{y}.cache_write')}, {x}.cache_write is null and {y}.cache_write is null)"])
    return f"({one(a, b)} and size({a}.tiers) = size({b}.tiers) and forall(zip_with({a}.tiers, {b}.tiers, (x_, y_) -> x_.above = y_.above and {one('x_', 'y_')}), ok_ -> coalesce(ok_, false)))"


def _let(name: str, value: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


SEGMENTS = f"array<struct<from: bigint, until: bigint, rates: {RATES}>>"
STATE = f"struct<owner: string, prices: {SEGMENTS}, pending: {RATES}, added: bigint, changed: bigint>"


def synced(base: DataFrame, observed: DataFrame, reads: DataFrame) -> DataFrame:
    """(key, owner, prices, pending, added, changed): a catalog after successive reads of both files.

    ``base``: (key, source, prices as SEGMENTS, pending as RATES), maybe empty; ``observed``: (read, key, source, rates), one of
    PRIMARY or FALLBACK; ``reads``: (read, at, primary_ok), times rising with reads. Of a read the primary's price counts,
    else the fallback's, unless the primary could not be read and owns the entry. A name that is not known becomes an
    entry from the beginning of time. A price of zero, or one that is missing, is no drop: the current one stays. A move
    of more than half is kept ``pending`` until the next read that differs tells it again. A change ends the segment that
    held and begins one at the read's time; two at one time are one. ``changed`` is the last read's time that changed it.
    """
    each = observed.groupBy("read", "key").agg(F.expr(f"any_value(rates) filter (where source = '{PRIMARY}')").alias("p"), F.expr(f"any_value(rates) filter (where source = '{FALLBACK}')").alias("f"))
    told = each.join(reads.select("read", "at", "primary_ok"), "read").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "read", "primary_ok", "p", "f"))).alias("seen"))
    start = base.select("key", F.struct(F.col("source").alias("owner"), F.array_sort("prices").alias("prices"), "pending", F.lit(None).cast("bigint").alias("added"), F.lit(None).cast("bigint").alias("changed")).cast(STATE).alias("s"))
    rows = start.join(told, "key", "full").withColumn("s", F.coalesce("s", F.expr(f"cast(named_struct('owner', cast(null as string), 'prices', cast(array() as {SEGMENTS}), 'pending', cast(null as {RATES}), 'added', null, 'changed', null) as {STATE})")))
    seg = lambda start, rates: f"named_struct('from', {start}, 'until', cast(null as bigint), 'rates', {rates})"
    state = lambda **new: "cast(named_struct(" + ", ".join(f"'{k}', {new.get(k, f'acc.{k}')}" for k in ("owner", "prices", "pending", "added", "changed")) + f") as {STATE})"
    pick = lambda k: f"if(obs.{k} > 0, obs.{k}, cur.rates.{k})"
    share = _let("in_", pick("input"), f"if(in_ > 0, t.input * {pick('cache_read')} / in_, t.input)")
    tiers = f"transform(if(size(obs.tiers) > 0, obs.tiers, cur.rates.tiers), t -> named_struct('above', t.above, 'input', t.input, 'output', t.output, 'cache_read', coalesce(t.cache_read, {share}), 'cache_write', t.cache_write))"
    overlay = "named_struct(" + ", ".join(f"'{k}', {pick(k)}" for k in ("input", "output", "cache_read", "cache_write")) + f", 'tiers', {tiers})"
    pair = lambda k: (f"coalesce(cur.rates.{k}, 0D)", f"coalesce(next.{k}, 0D)")
    moves = [f"case when {_same(*pair(k))} then 0D when {pair(k)[0]} > 0 then abs({pair(k)[1]} - {pair(k)[0]}) / {pair(k)[0]} else double('Infinity') end" for k in ("input", "output", "cache_read", "cache_write")]
    kept = "slice(acc.prices, 1, size(acc.prices) - 1)"
    last = "if(cur.from >= e.at, array(" + seg("cur.from", "next") + "), array(named_struct('from', cur.from, 'until', e.at, 'rates', cur.rates), " + seg("e.at", "next") + "))"
    step = f"case when {_same_rates('cur.rates', 'next')} then {state(pending=f'cast(null as {RATES})')} when greatest({', '.join(moves)}) > {CONFIRM} and not coalesce({_same_rates('acc.pending', 'next')}, false) then {state(pending='next')} else {state(prices=f'concat({kept}, cast({last} as {SEGMENTS}))', pending=f'cast(null as {RATES})', changed='e.at')} end"
    known = _let("cur", "element_at(acc.prices, -1)", _let("next", f"cast({overlay} as {RATES})", step))
    new = state(owner=f"if(e.p is not null, '{PRIMARY}', '{FALLBACK}')", prices=f"cast(array({seg('0L', _filled('obs'))}) as {SEGMENTS})", added="e.at")
    fold = _let("obs", f"coalesce(e.p, if(e.primary_ok or coalesce(acc.owner, '') <> '{PRIMARY}', e.f, null))", f"case when obs is null then acc when size(acc.prices) = 0 then {new} else {known} end")
    done = rows.select("key", F.expr(f"aggregate(coalesce(seen, array()), s, (acc, e) -> {fold})").alias("s"))
    return done.select("key", "s.*").where("size(prices) > 0")


def stale(reads: DataFrame, now: int, after: int = 86_400_000) -> DataFrame:
    """One row (fetched_at, stale): the last read that worked, and whether it is over a day ago or missing."""
    at = F.max(F.when(F.col("primary_ok") | F.col("fallback_ok"), F.col("at")))
    return reads.agg(at.alias("fetched_at")).withColumn("stale", F.coalesce(F.lit(now) - F.col("fetched_at") > after, F.lit(True)))

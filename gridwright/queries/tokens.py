"""Tokens, collation, masking and augmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright.operators import augment as aug
from gridwright.operators import tokenize as tok
from gridwright.plans.storage import scratch_path
from gridwright.queries.base import query, rounded, table

# ---------------------------------------------------------------- tokens

_TOKSRC = """(SELECT p_partkey, CASE WHEN p_partkey % 9 <> 0 THEN p_brand END AS p_brand, p_type, p_retailprice, p_size FROM part)"""


def tok_input(spark, sf):
    t = table(spark, sf, "part")
    return t.select("p_partkey", F.when(F.col("p_partkey") % 9 != 0, F.col("p_brand")).alias("p_brand"), "p_type", "p_retailprice", "p_size")


def _vocab_sql(c: str, src: str) -> str:
    return f"""(SELECT token, row_number() OVER (ORDER BY token) - 1 AS token_id FROM (SELECT DISTINCT coalesce({c}, 'NaN') AS token FROM {src} UNION SELECT '<UNK>' UNION SELECT '<MASK>'))"""


def _bin_sql(c: str, src: str, n: int) -> str:
    edges = f"(SELECT quantile_cont({c}, [{', '.join(str(i / n) for i in range(n + 1))}]) FROM {src})"
    return f"least(greatest(len(list_filter({edges}, lambda v: v <= {c})) - 1, 0), {n - 1})"


@query(
    "tok1_feature_tokens",
    f"""SELECT p_partkey, b.token_id || ':1,' || t.token_id || ':1,' || {_bin_sql('p_retailprice', _TOKSRC, 10)} || ':1,0:0' AS ids,
    round((p_retailprice - m) / s, 6) AS price FROM {_TOKSRC} p JOIN {_vocab_sql('p_brand', _TOKSRC)} b ON b.token = coalesce(p_brand, 'NaN')
    JOIN {_vocab_sql('p_type', _TOKSRC)} t ON t.token = p_type, (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s FROM part)""",
)
def tok1(spark, sf):
    df = tok_input(spark, sf).withColumn("later", F.col("p_size") * 1.5)
    fitted = tok.fit_tokenizer(df, ["p_brand", "p_type", "p_retailprice", "later"], n_bins=10)
    out = fitted.transform(df.drop("later"))  # a feature absent at transform time
    cell = F.transform("tokens", lambda t: F.concat(t["token_id"].cast("string"), F.lit(":"), t["present"].cast("int").cast("string")))
    return rounded(out.select("p_partkey", F.array_join(cell, ",").alias("ids"), F.col("tokens")[2]["values"][0].alias("price")))


_TOKENS = f"""(SELECT token, 5 + row_number() OVER (ORDER BY token) AS id FROM (SELECT DISTINCT 'p_brand=' || p_brand AS token FROM {_TOKSRC} WHERE p_brand IS NOT NULL
  UNION SELECT 'p_type=' || p_type FROM part UNION SELECT 'p_size#' || {_bin_sql('p_size', _TOKSRC, 5)} FROM {_TOKSRC}))"""


def _fit_vocab(spark, sf):
    df = tok_input(spark, sf)
    return df, tok.fit_vocabulary(df, ["p_brand", "p_type", "p_size"], binned=["p_size"], n_bins=5)


@query(
    "tok2_table_tokens",
    f"""SELECT p_partkey, '2,' || coalesce(b.id, 5) || ',' || t.id || ',' || s.id || ',3,0,0,0' AS input_ids, '1,1,1,1,1,0,0,0' AS attention_mask
    FROM {_TOKSRC} p LEFT JOIN {_TOKENS} b ON b.token = 'p_brand=' || p_brand JOIN {_TOKENS} t ON t.token = 'p_type=' || p_type
    JOIN {_TOKENS} s ON s.token = 'p_size#' || {_bin_sql('p_size', _TOKSRC, 5)}""",
)
def tok2(spark, sf):
    df, vocab = _fit_vocab(spark, sf)
    out = vocab.encode(df, 8)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return out.select("p_partkey", text("input_ids"), text("attention_mask"))


@query(
    "tok3_special_tokens",
    """SELECT conv_id, turn, '2,' || length(text) || ',' || turn || ',3,' || turn || ',3' AS ids,
    '1,' || (length(text) < 6)::INT || ',' || (turn < 6)::INT || ',1,' || (turn < 6)::INT || ',1' AS special, '0,0,0,0,1,1' AS type_ids FROM conversations""",
)
def tok3(spark, sf):
    t = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.array(F.length("text"), F.col("turn").cast("int")).alias("a"), F.array(F.col("turn").cast("int")).alias("b")
    )
    ids = tok.with_special_tokens(F.col("a"), F.col("b"))
    text = lambda c, n: F.array_join(c.cast("array<string>"), ",").alias(n)
    return t.select("conv_id", "turn", text(ids, "ids"), text(tok.special_tokens_mask(ids), "special"), text(tok.pair_type_ids(F.col("a"), F.col("b")), "type_ids"))


@query(
    "tok4_decode",
    f"""SELECT p_partkey, '[CLS] ' || coalesce('p_brand=' || p_brand, '[MISSING]') || ' p_type=' || p_type || ' p_size#' || {_bin_sql('p_size', _TOKSRC, 5)} || ' [SEP]' AS text FROM {_TOKSRC}""",
)
def tok4(spark, sf):
    df, vocab = _fit_vocab(spark, sf)
    return tok.ids_to_tokens(vocab.encode(df, 8, padding=False), ["p_partkey"], "input_ids", vocab.tokens)


@query("snk4_vocabulary", f"SELECT regexp_extract(token, '^(.*?)[=#]', 1) AS \"column\", token, id::INT AS token_id FROM {_TOKENS} UNION ALL SELECT '', t, i::INT FROM (SELECT unnest(['[PAD]','[UNK]','[CLS]','[SEP]','[MASK]','[MISSING]']) AS t, unnest(range(6)) AS i)")
def snk4(spark, sf):
    _, vocab = _fit_vocab(spark, sf)
    path = scratch_path(spark, "vocabulary")
    vocab.save(path)
    loaded = tok.load_vocabulary(spark, path)
    return loaded.select(F.regexp_extract("token", "^(.*?)[=#]", 1).alias("column"), "token", "token_id")


@query(
    "col1_pad",
    """WITH c AS (SELECT conv_id, turn::INT AS turn, length(text)::INT AS n FROM conversations), g AS (SELECT conv_id, list(n ORDER BY turn) AS l FROM c GROUP BY 1),
    w AS (SELECT *, conv_id % 3 AS grp, max(len(l)) OVER (PARTITION BY conv_id % 3) AS w FROM g)
    SELECT conv_id, array_to_string(l || list_transform(range(w - len(l)), lambda i: 0), ',') AS padded, repeat('1', len(l)) || repeat('0', w - len(l)) AS mask, len(l)::INT AS length,
    CASE WHEN len(l) >= 3 THEN array_to_string(l[1:3], ',') ELSE array_to_string(l || list_transform(range(3 - len(l)), lambda i: 0), ',') END AS fixed FROM w""",
)
def col1(spark, sf):
    c = table(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.col("turn"), F.length("text").alias("n")))).alias("s"))
    g = g.select("conv_id", (F.col("conv_id") % 3).alias("grp"), F.col("s")["n"].alias("l"), F.col("s")["n"].alias("raw"))
    out = tok.pad_to_group(g, "l", ["grp"])
    text = lambda c, sep, n: F.array_join(c.cast("array<string>"), sep).alias(n)
    return out.select("conv_id", text(F.col("l"), ",", "padded"), text(F.col("attention_mask"), "", "mask"),
                      tok.lengths_from_mask(F.col("attention_mask")).alias("length"), text(tok.pad(F.col("raw"), F.lit(3), 0), ",", "fixed"))


@query(
    "col2_batches",
    """SELECT shard, (r - 1) // 16 AS batch_id, count(*)::INT AS n, string_agg(event_id, ',' ORDER BY r) AS ids FROM (
    SELECT event_id, user_id % 4 AS shard, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) AS r FROM events) GROUP BY 1, 2""",
)
def col2(spark, sf):
    t = table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 4).alias("shard"))
    out = tok.batches(t, "shard", ["ts", "event_id"], ["event_id"], 16)
    return out.select("shard", "batch_id", "n", F.array_join(F.col("event_id").cast("array<string>"), ",").alias("ids"))


# ---------------------------------------------------------------- masking and augmentation

# one row per part with eight features; every fifth part lacks its third feature
ROW = "[p_retailprice / 1000, p_size::DOUBLE, (p_partkey % 10)::DOUBLE, (p_partkey % 7)::DOUBLE, length(p_name)::DOUBLE, length(p_type)::DOUBLE, p_size / 10.0, 1.0]"
ROWS = f"(SELECT p_partkey AS k, {ROW}::DOUBLE[] AS x, [1, 1, (p_partkey % 5 <> 0)::INT, 1, 1, 1, 1, 1] AS m FROM part)"


def rows(spark, sf):
    k = F.col("p_partkey")
    x = F.array(F.col("p_retailprice") / 1000, F.col("p_size").cast("double"), (k % 10).cast("double"), (k % 7).cast("double"),
                F.length("p_name").cast("double"), F.length("p_type").cast("double"), F.col("p_size") / 10.0, F.lit(1.0))
    m = F.array(*[(k % 5 != 0).cast("int") if i == 2 else F.lit(1) for i in range(8)])
    return table(spark, sf, "part").select(k.alias("k"), x.alias("x"), m.alias("m"))


def _h(salt: str, i: str = "i", seed: int = 42) -> str:
    return f"md5(concat_ws('|', k, {i}, '{salt}', '{seed}'))"


def _u(salt: str, start: int = 1, i: str = "i", seed: int = 42) -> str:
    return f"(CAST(CAST('0x' || substr({_h(salt, i, seed)}, {start}, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0)"


def _gate(salt: str, seed: int = 42) -> str:
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', k, 'gate-{salt}', '{seed}')), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0)"


def _g(salt: str) -> str:
    return f"(sqrt(-2 * ln(greatest({_u(salt)}, 2.0 ** -52))) * cos(2 * pi() * {_u(salt, 17)}))"


_LONG = f"(SELECT k, unnest(range(8))::INT AS i, unnest(x) AS v, unnest(m) AS valid FROM {ROWS})"


def exploded(df, cols, digits=6):
    """(k, i, one column per array)."""
    z = df.select("k", F.posexplode(F.arrays_zip(*[F.col(c).alias(c) for c in cols])).alias("i", "z")).select("k", "i", *[F.col("z")[c].alias(c) for c in cols])
    return rounded(z, digits)


@query(
    "msk1_cells",
    f"""WITH r AS (SELECT *, sum(valid) OVER (PARTITION BY k) AS nv, CASE WHEN valid = 1 THEN row_number() OVER (PARTITION BY k ORDER BY valid DESC, {_h('cell')}) END AS rk FROM {_LONG}),
    s AS (SELECT *, (coalesce(rk <= greatest(1, floor(nv * 0.3::DOUBLE)), false))::INT AS mask FROM r)
    SELECT k, i, mask, round(CASE WHEN mask = 0 THEN v WHEN {_u('act')} < 0.8 THEN 0 WHEN {_u('act')} < 0.9 THEN {_g('rnd')} ELSE v END, 6) AS masked, round(v, 6) AS original FROM s""",
)
def msk1(spark, sf):
    return exploded(aug.mask_cells(rows(spark, sf), ["k"], 0.3), ["mask", "masked", "original"])


@query(
    "msk2_independent",
    f"SELECT k, i, (valid = 1 AND {_u('ind')} < 0.15)::INT AS mask, round(CASE WHEN valid = 1 AND {_u('ind')} < 0.15 THEN 0 ELSE v END, 6) AS masked FROM {_LONG}",
)
def msk2(spark, sf):
    return exploded(aug.mask_independent(rows(spark, sf), ["k"]), ["mask", "masked"])


@query(
    "msk3_columns",
    f"""WITH c AS (SELECT i FROM (SELECT unnest(range(8))::INT AS i) ORDER BY md5(concat_ws('|', i, 'column', '42')) LIMIT 2)
    SELECT k, i, (i IN (FROM c))::INT AS mask, round(CASE WHEN i IN (FROM c) THEN 0 ELSE v END, 6) AS masked FROM {_LONG}""",
)
def msk3(spark, sf):
    return exploded(aug.mask_columns(rows(spark, sf), ["k"], 8, 0.3), ["mask", "masked"])


@query(
    "msk4_columns_per_row",
    f"""WITH r AS (SELECT *, (valid = 1 AND {_u('colrow')} < 0.15)::INT AS hit, CASE WHEN valid = 1 THEN row_number() OVER (PARTITION BY k ORDER BY valid DESC, {_h('colrow')}) END AS rk FROM {_LONG}),
    s AS (SELECT *, CASE WHEN sum(hit) OVER (PARTITION BY k) >= 2 THEN hit ELSE coalesce(rk <= 2, false)::INT END AS mask FROM r)
    SELECT k, i, mask, round(CASE WHEN mask = 1 THEN 0 ELSE v END, 6) AS masked FROM s""",
)
def msk4(spark, sf):
    return exploded(aug.mask_columns_per_row(rows(spark, sf), ["k"], 0.15, 2), ["mask", "masked"])


@query(
    "aug1_noise",
    f"SELECT k, i, round(CASE WHEN {_gate('noise')} < 0.5 AND valid = 1 THEN v + 0.1 * {_g('noise')} ELSE v END, 5) AS x FROM {_LONG}",
)
def aug1(spark, sf):
    return exploded(aug.noise(rows(spark, sf), ["k"]), ["x"], 5)


@query(
    "aug2_dropout",
    f"""WITH r AS (SELECT *, sum(valid) OVER (PARTITION BY k) AS nv, CASE WHEN valid = 1 THEN row_number() OVER (PARTITION BY k ORDER BY valid DESC, {_h('dropout')}) END AS rk FROM {_LONG}),
    s AS (SELECT *, ({_gate('dropout')} < 0.5 AND coalesce(rk <= least(floor(nv * 0.4::DOUBLE), nv - 1), false)) AS hit FROM r)
    SELECT k, i, round(CASE WHEN hit THEN 0 ELSE v END, 6) AS x, CASE WHEN hit THEN 0 ELSE valid END AS m FROM s""",
)
def aug2(spark, sf):
    return exploded(aug.dropout(rows(spark, sf), ["k"], 0.4), ["x", "m"])


@query(
    "aug3_shuffle",
    f"""WITH p AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {_h('shuffle')}) AS rk FROM {_LONG}),
    t AS (SELECT k, i, rk FROM p WHERE rk <= 4), f AS (SELECT k, i AS src, row_number() OVER (PARTITION BY k ORDER BY {_h('shuffle-2')}) AS rk FROM t)
    SELECT p.k, p.i, round(CASE WHEN {_gate('shuffle').replace('k,', 'p.k,')} < 0.3 AND f.src IS NOT NULL THEN o.v ELSE p.v END, 6) AS x FROM p LEFT JOIN f ON f.k = p.k AND f.rk = p.rk AND p.rk <= 4
    LEFT JOIN p o ON o.k = p.k AND o.i = f.src""",
)
def aug3(spark, sf):
    return exploded(aug.shuffle_features(rows(spark, sf), ["k"]), ["x"])


@query(
    "aug4_cutmix",
    f"""WITH h AS (SELECT k, x, md5(concat_ws('|', k, '', '42')) AS h FROM {ROWS}),
    o AS (SELECT k, x, coalesce(lead(x) OVER (ORDER BY h), first_value(x) OVER (ORDER BY h)) AS o FROM h),
    l AS (SELECT k, unnest(range(8))::INT AS i, unnest(x) AS v, unnest(o) AS ov FROM o),
    r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY {_h('cutmix')}) AS rk FROM l)
    SELECT k, i, round(CASE WHEN {_gate('cutmix')} < 0.5 AND rk <= 2 THEN ov ELSE v END, 6) AS x FROM r""",
)
def aug4(spark, sf):
    return exploded(aug.cutmix(rows(spark, sf), ["k"], probability=0.5), ["x"])


@query(
    "aug5_scaling",
    f"SELECT k, i, round(CASE WHEN {_gate('scaling')} < 0.3 AND {_u('scaling', 17)} < 0.5 THEN v * (0.9 + 0.2 * {_u('scaling')}) ELSE v END, 6) AS x FROM {_LONG}",
)
def aug5(spark, sf):
    return exploded(aug.scaling(rows(spark, sf), ["k"], feature_probability=0.5), ["x"])


@query(
    "aug6_missing",
    f"""WITH r AS (SELECT *, {_u('missing')} < 0.2 AS hide FROM {_LONG})
    SELECT k, i, round(CASE WHEN {_gate('missing')} < 0.3 AND hide THEN coalesce(avg(v) FILTER (NOT hide) OVER (PARTITION BY k), 0) ELSE v END, 6) AS x FROM r""",
)
def aug6(spark, sf):
    return exploded(aug.simulate_missing(rows(spark, sf), ["k"], 0.2), ["x"])


@query(
    "aug6_missing_median",
    f"""WITH r AS (SELECT *, {_u('missing')} < 0.2 AS hide FROM {_LONG}), f AS (SELECT k, coalesce(quantile_cont(v, 0.5) FILTER (NOT hide), 0) AS f FROM r GROUP BY k)
    SELECT k, i, round(CASE WHEN {_gate('missing')} < 0.3 AND hide THEN f ELSE v END, 6) AS x FROM r JOIN f USING (k)""",
)
def aug6_median(spark, sf):
    return exploded(aug.simulate_missing(rows(spark, sf), ["k"], 0.2, "median"), ["x"])


def _ku(salt: str) -> str:
    return f"(CAST(CAST('0x' || substr(md5(concat_ws('|', c_custkey, '{salt}', '42')), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0)"


@query(
    "aug7_perturb",
    f"""SELECT c_custkey, CASE WHEN {_ku('swapgate-c_mktsegment')} < 0.1 THEN (SELECT list(s ORDER BY s) FROM (SELECT DISTINCT c_mktsegment AS s FROM customer))[floor({_ku('swap-c_mktsegment')} * 5)::INT + 1]
    ELSE c_mktsegment END AS c_mktsegment FROM customer""",
)
def aug7(spark, sf):
    from gridwright.operators.encode import fit_categories

    t = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return aug.swap_category(t, ["c_custkey"], "c_mktsegment", fit_categories(t, "c_mktsegment"))


@query(
    "aug7_perturb_numbers",
    f"SELECT k, i, round(CASE WHEN {_gate('perturb')} < 0.4 AND valid = 1 AND i IN (0, 1, 6) THEN v + 0.05 * {_g('perturb')} ELSE v END, 5) AS x FROM {_LONG}",
)
def aug7_numbers(spark, sf):
    return exploded(aug.perturb_numbers(rows(spark, sf), ["k"], features=[0, 1, 6]), ["x"], 5)


@query(
    "aug8_temporal_shift",
    f"""WITH s AS (SELECT k, x, {_gate('shift')} < 0.5 AS go, floor(CAST(CAST('0x' || substr(md5(concat_ws('|', k, 'shift', '42')), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 * 5)::INT - 2 AS s FROM {ROWS}),
    l AS (SELECT k, x, go, s, unnest(range(8))::INT AS i FROM s)
    SELECT k, i, round(CASE WHEN NOT go THEN x[i + 1] WHEN i + s < 0 OR i + s > 7 THEN 0 ELSE x[i + s + 1] END, 6) AS x FROM l""",
)
def aug8(spark, sf):
    return exploded(aug.temporal_shift(rows(spark, sf), ["k"], "x"), ["x"])


@query("aug9_strong_preset")
def aug9(spark, sf):
    return exploded(aug.compose(rows(spark, sf), aug.train_steps(["k"], "strong")), ["x", "m"])


@query(
    "aug9_validation_preset",
    f"""SELECT k, i, round((v - avg(v) OVER w) / (stddev_samp(v) OVER w + 1e-8), 6) AS x FROM {_LONG} WINDOW w AS (PARTITION BY k)""",
)
def aug9_validation(spark, sf):
    return exploded(aug.compose(rows(spark, sf), aug.validation_steps()), ["x"])


@query("aug10_two_views")
def aug10(spark, sf):
    return exploded(aug.two_views(rows(spark, sf), ["k"]), ["anchor", "positive"])

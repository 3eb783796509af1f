"""Queries of vector arithmetic, quantised products, routing and pictures as pixel relations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import imaging as pixels
from quire.functions import kernels, tokens, vectors
from quire.operators import imaging, quantise, routing, sequences
from quire.plans.base import query, table


def doubles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def digest(v: Column) -> Column:
    """The entries weighed by their place, so that a swap shows."""
    return F.round(vectors.total(F.transform(v, lambda x, i: x * (i + 1))), 6)


_V = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"


def _digest(expression: str) -> str:
    """The same in DuckDB, of an expression over v, the entry x and its place i."""
    return f"round(list_sum(list_transform(range(1, len(v) + 1), lambda i: ({expression}) * i)), 6)"


_ERF = "sign({z}) * (1 - (1 / (1 + 0.3275911::DOUBLE * abs({z}))) * (0.254829592::DOUBLE + (1 / (1 + 0.3275911::DOUBLE * abs({z}))) * (-0.284496736::DOUBLE + (1 / (1 + 0.3275911::DOUBLE * abs({z}))) * (1.421413741::DOUBLE + (1 / (1 + 0.3275911::DOUBLE * abs({z}))) * (-1.453152027::DOUBLE + (1 / (1 + 0.3275911::DOUBLE * abs({z}))) * 1.061405429::DOUBLE)))) * exp(-({z}) * ({z})))"


@query(f"""SELECT vec_id, {_digest("v[i] / (1 + exp(-v[i]))")} AS silu, {_digest("greatest(v[i], 0)")} AS relu, {_digest("v[i] / (1 + exp(-1.702::DOUBLE * v[i]))")} AS quick, {_digest(f"0.5::DOUBLE * v[i] * (1 + tanh({math.sqrt(2 / math.pi)!r}::DOUBLE * (v[i] + 0.044715::DOUBLE * v[i] * v[i] * v[i])))")} AS tanh,
{_digest("0.5::DOUBLE * v[i] * (1 + " + _ERF.format(z=f"(v[i] / {math.sqrt(2)!r}::DOUBLE)") + ")")} AS gelu FROM {_V}""")
def q102_activations(spark: SparkSession, folder: str) -> DataFrame:
    e = doubles(spark, folder)
    kinds = {"silu": vectors.silu, "relu": vectors.relu, "quick": vectors.quick_gelu, "tanh": vectors.gelu_tanh, "gelu": vectors.gelu}
    return e.select("vec_id", *[digest(f(F.col("v"))).alias(n) for n, f in kinds.items()])


@query(f"""WITH m AS (SELECT *, list_avg(v) AS m, list_avg(list_transform(v, lambda x: x * x)) AS q FROM {_V}), d AS (SELECT *, list_avg(list_transform(v, lambda x: (x - m) * (x - m))) AS d FROM m),
g AS (SELECT vec_id, k, list_avg(v[k * 16 + 1:k * 16 + 16]) AS gm, v FROM m, (VALUES (0), (1), (2), (3)) AS t(k)), h AS (SELECT *, list_avg(list_transform(v[k * 16 + 1:k * 16 + 16], lambda x: (x - gm) * (x - gm))) AS gd FROM g),
s AS (SELECT vec_id, sum(list_sum(list_transform(range(k * 16 + 1, k * 16 + 17), lambda i: (v[i] - gm) / sqrt(gd + 1e-5::DOUBLE) * i))) AS grouped FROM h GROUP BY vec_id)
SELECT vec_id, {_digest("v[i] / sqrt(q + 1e-6::DOUBLE)")} AS rms, {_digest("(v[i] - m) / sqrt(d + 1e-5::DOUBLE)")} AS layer, round(grouped, 6) AS grouped FROM d JOIN s USING (vec_id)""")
def q103_norms(spark: SparkSession, folder: str) -> DataFrame:
    v = F.col("v")
    return doubles(spark, folder).select("vec_id", digest(vectors.rms_norm(v)).alias("rms"), digest(vectors.layer_norm(v)).alias("layer"), digest(vectors.group_norm(v, 4)).alias("grouped"))


_ANGLE = "(vec_id % 100) * pow(10000.0::DOUBLE, -2.0::DOUBLE * ({i}) / 64)"


@query(f"""SELECT vec_id, {_digest(f"CASE WHEN i <= 32 THEN v[i] * cos({_ANGLE.format(i='i - 1')}) - v[i + 32] * sin({_ANGLE.format(i='i - 1')}) ELSE v[i] * cos({_ANGLE.format(i='i - 33')}) + v[i - 32] * sin({_ANGLE.format(i='i - 33')}) END")} AS turned FROM {_V}""")
def q104_rotary(spark: SparkSession, folder: str) -> DataFrame:
    return doubles(spark, folder).select("vec_id", digest(vectors.rope(F.col("v"), F.col("vec_id") % 100)).alias("turned"))


_INT4 = f"""SELECT vec_id, v, list_transform(range(0, 4), lambda g: CASE WHEN list_max(list_transform(v[g * 16 + 1:g * 16 + 16], lambda x: abs(x))) = 0 THEN 1.0::DOUBLE ELSE list_max(list_transform(v[g * 16 + 1:g * 16 + 16], lambda x: abs(x))) / 7.0::DOUBLE END) AS s FROM {_V}"""
_Q4 = f"SELECT vec_id, v, s, list_transform(range(0, 64), lambda i: CAST(greatest(least(round_even(v[i + 1] / s[i // 16 + 1], 0), 7), -8) AS BIGINT)) AS q FROM ({_INT4})"


@query(f"""SELECT vec_id, array_to_string(list_transform(range(0, 32), lambda i: (q[2 * i + 1] & 15) | ((q[2 * i + 2] & 15) << 4)), ',') AS packed, array_to_string(q, ',') AS unpacked FROM ({_Q4})""")
def q105_int4(spark: SparkSession, folder: str) -> DataFrame:
    """Packed four-bit rows in groups of sixteen, and the same unpacked."""
    r = doubles(spark, folder).select("vec_id", vectors.int4_groups(F.col("v"), 16).alias("r"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return r.select("vec_id", listed(F.col("r.packed")).alias("packed"), listed(vectors.int4_unpack(F.col("r.packed"))).alias("unpacked"))


@query(f"""WITH q AS ({_Q4}) SELECT vec_id, round(list_sum(list_transform(range(0, 4), lambda g: s[g + 1] * list_sum(list_transform(range(g * 16 + 1, g * 16 + 17), lambda i: q[i] * v[i])))), 6) AS product FROM q""")
def q106_int4_product(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector with its own four-bit form."""
    r = doubles(spark, folder).select("vec_id", "v", vectors.int4_groups(F.col("v"), 16).alias("r"))
    return r.select("vec_id", F.round(quantise.int4_dot(F.col("v"), F.col("r.packed"), F.col("r.scales"), 16), 6).alias("product"))


@query(f"""WITH h AS (SELECT label, arg_min(v, vec_id) AS w FROM {_V} GROUP BY label) SELECT vec_id AS i, h.label AS j, round(list_inner_product(v, w), 6) AS product FROM {_V}, h WHERE vec_id % 10 = 0""")
def q107_block_product(spark: SparkSession, folder: str) -> DataFrame:
    """Every tenth vector times the first of each label, by blocks of cells."""
    e = doubles(spark, folder)
    heads = e.groupBy(F.col("label").alias("j")).agg(F.min_by("v", "vec_id").alias("v"))
    return quantise.block_product(e.where("vec_id % 10 = 0").select(F.col("vec_id").alias("i"), "v"), heads).withColumn("product", F.round("product", 6))


@query(f"""SELECT vec_id, {_digest("v[((i - 1) % 8) * 8 + (i - 1) // 8 + 1]")} AS transposed, round(list_sum(list_transform(range(1, 73), lambda i: i * CASE WHEN i % 9 = 0 THEN i // 9 - 1 ELSE v[(i - 1) // 9 * 8 + (i - 1) % 9 + 1] END)), 6) AS widened,
{_digest("v[(((i - 1) // 8) // 2 * 4 + ((i - 1) % 8) // 4 * 2 + ((i - 1) // 8) % 2 * 1) // 1 * 0 + ((((i - 1) // 8) // 2) * 2 + ((i - 1) % 8) // 4) * 8 + ((i - 1) // 8 % 2) * 4 + (i - 1) % 4 + 1]")} AS tiles FROM {_V}""")
def q108_rearranged(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as eight rows of eight: transposed, with their row numbers as a ninth column, and read as tiles of two rows of four."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("v", r * 8 + 1, 8))
    tiles = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.array(F.slice("v", t * 8 + 1, 4), F.slice("v", t * 8 + 5, 4)))
    e = doubles(spark, folder).select("vec_id", rows.alias("r"), tiles.alias("t"))
    numbers = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: r.cast("double"))
    flat = lambda x: digest(F.flatten(x))
    return e.select("vec_id", flat(vectors.transpose(F.col("r"))).alias("transposed"), flat(vectors.with_column(F.col("r"), numbers)).alias("widened"), flat(vectors.tile_rows(F.col("t"), 2)).alias("tiles"))


@query(f"""WITH s AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM {_V}), u AS (SELECT vec_id, v, unnest(range(0, 64)) AS expert, unnest(e) / list_sum(e) AS w FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY w DESC, expert) AS slot FROM u),
t AS (SELECT vec_id, v, expert, w / (sum(w) OVER (PARTITION BY vec_id) + 1e-20::DOUBLE) AS w FROM r WHERE slot <= 4), g AS (SELECT vec_id, any_value(v) AS v, sum(w * (expert + 1)) AS f FROM t GROUP BY vec_id) SELECT vec_id, {_digest("v[i] * f")} AS mixed FROM g""")
def q109_expert_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Four of 64 experts for each vector, each multiplying by its number, summed in order of slot."""
    e = doubles(spark, folder)
    routed = routing.routes(e, "vec_id", F.col("v"), 4)
    return routing.dispatch(e, "vec_id", "v", routed, lambda k, x: x * (k + 1)).select("vec_id", digest(F.col("v")).alias("mixed"))


@query(f"""WITH h AS (SELECT label, arg_min(v, vec_id) AS w FROM {_V} GROUP BY label), c AS (SELECT v.label, vec_id, list_sum(list_transform(range(1, 65), lambda i: round(v[i], 1) * round(w[i], 1))) AS rough, list_inner_product(v, w) AS score FROM {_V} v JOIN h USING (label)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY rough DESC, vec_id) AS n FROM c) WHERE n <= 20) SELECT label, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM k) WHERE r <= 5""")
def q110_rescored(spark: SparkSession, folder: str) -> DataFrame:
    """For the first vector of each label the twenty that look nearest at one decimal, and of them the five nearest."""
    e = doubles(spark, folder)
    heads = e.groupBy("label").agg(F.min_by("v", F.when(F.col("v").isNotNull(), F.col("vec_id"))).alias("w"))
    cut = lambda c: F.transform(c, lambda x: F.round(x, 1))
    # the rough sums are ranked as they are: rounded ones would tie where the plain sums don't
    scored = e.join(heads, "label").select("label", "vec_id", vectors.dot(cut("v"), cut("w")).alias("rough"), vectors.dot(F.col("v"), F.col("w")).alias("exact"))
    return routing.rescore(scored, "label", "vec_id", "rough", "exact", 20, 5).withColumn("score", F.round("score", 6))


@query("""WITH e AS (SELECT vec_id, embedding AS v, [vec_id % 64, (vec_id * 7) % 64, vec_id % 64, (vec_id * 3) % 64, vec_id % 64] AS h FROM embeddings), b AS (SELECT *, list_transform(list_filter(range(1, 5), lambda i: h[i] = h[5]), lambda i: h[i + 1]) AS out FROM e),
c AS (SELECT vec_id, list_reduce(list_transform(list_filter(range(0, 64), lambda i: NOT list_contains(out, i)), lambda i: {'i': i, 'x': v[i + 1]}), lambda a, y: CASE WHEN y.x > a.x THEN y ELSE a END).i AS t FROM b) SELECT vec_id, CAST(t AS INTEGER) AS token, t = 63 AS is_end FROM c""")
def q111_greedy_token(spark: SparkSession, folder: str) -> DataFrame:
    """The best component as the next token; a pair that ends in the last token isn't repeated."""
    k = F.col("vec_id")
    history = F.transform(F.array(k % 64, k * 7 % 64, k % 64, k * 3 % 64, k % 64), lambda x: x.cast("string"))
    return table(spark, folder, "embeddings").select("vec_id", tokens.greedy(F.col("embedding"), history, 2, 63).alias("g")).select("vec_id", "g.*")


@query(f"""WITH h AS (SELECT label, arg_min(v, vec_id) AS q FROM {_V} GROUP BY label), s AS (SELECT label, v, exp(list_inner_product(q, v) / 8) AS w FROM {_V} JOIN h USING (label)), u AS (SELECT label, w, unnest(range(1, 65)) AS i, unnest(v) AS x FROM s)
SELECT label, round(sum(o * i), 6) AS attended FROM (SELECT label, i, sum(w * x) / sum(w) AS o FROM u GROUP BY ALL) GROUP BY label""")
def q112_attention(spark: SparkSession, folder: str) -> DataFrame:
    """The first vector of each label as a query over all of them, by online softmax."""
    g = doubles(spark, folder).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("r")).select("label", F.transform("r", lambda x: x["v"]).alias("vs"))
    return g.select("label", digest(sequences.attend(F.get("vs", 0), F.col("vs"), F.col("vs"))).alias("attended"))


@query("""SELECT vec_id, list_sum(list_transform(range(0, 21), lambda i: ((CAST(floor((embedding[3 * i + 1]::DOUBLE + 1) * 127) AS BIGINT) * 19595 + CAST(floor((embedding[3 * i + 2]::DOUBLE + 1) * 127) AS BIGINT) * 38470 + CAST(floor((embedding[3 * i + 3]::DOUBLE + 1) * 127) AS BIGINT) * 7471 + 32768) >> 16) * (i + 1)))::BIGINT AS luma,
((255 - vec_id % 256) * (255 - vec_id * 7 % 256)) // 255 AS red FROM embeddings""")
def q113_luma_and_inks(spark: SparkSession, folder: str) -> DataFrame:
    v = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127).cast("int"))
    e = table(spark, folder, "embeddings").select("vec_id", v.alias("v"))
    greys = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: pixels.luma(F.get("v", 3 * i), F.get("v", 3 * i + 1), F.get("v", 3 * i + 2)) * (i + 1))
    red = pixels.cmyk(F.col("vec_id") % 256, F.lit(0), F.lit(0), F.col("vec_id") * 7 % 256)["r"]
    return e.select("vec_id", F.aggregate(greys, F.lit(0).cast("long"), lambda t, x: t + x).alias("luma"), red.cast("long").alias("red"))


_PIX = "(SELECT vec_id AS image, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(floor((e::DOUBLE + 1) * 127) AS INTEGER) AS v FROM (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS e FROM embeddings))"


def squares(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as pictures of eight by eight."""
    p = table(spark, folder, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("i", "e"))
    return p.select("image", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), F.floor((F.col("e").cast("double") + 1) * 127).cast("int").alias("v"))


def per_image(found: DataFrame, width: int) -> DataFrame:
    """One row per picture: how many pixels, and their sum weighed by place."""
    return found.groupBy("image").agg(F.count("*").alias("n"), F.round(F.sum(F.col("v").cast("double") * (F.col("y") * width + F.col("x") + 1)), 4).alias("digest"))


@query(f"""WITH w AS (SELECT image, wy AS y, wx AS x, max(v) AS v FROM {_PIX} p, range(0, 3) a(wy), range(0, 3) b(wx) WHERE p.y BETWEEN wy * 2 AND wy * 2 + 2 AND p.x BETWEEN wx * 2 AND wx * 2 + 2 GROUP BY ALL) SELECT image, count(*) AS n, round(sum(v::DOUBLE * (y * 3 + x + 1)), 4) AS digest FROM w GROUP BY image""")
def q114_pooling(spark: SparkSession, folder: str) -> DataFrame:
    """The greatest of each window of three, two apart."""
    return per_image(imaging.pooled(squares(spark, folder), 3, 2, 8, 8), 3)


_KERNEL = [[1.0, 2.0, 1.0], [0.0, 0.5, 0.0], [-1.0, -2.0, -1.0]]


@query(f"""WITH k(dy, dx, w) AS (VALUES {", ".join(f"({1 - i}, {1 - j}, {w}::DOUBLE)" for i, line in enumerate(_KERNEL) for j, w in enumerate(line))}), c AS (SELECT image, y + dy AS y, x + dx AS x, sum(v * w) AS v FROM {_PIX}, k GROUP BY ALL)
SELECT image, count(*) AS n, round(sum(v * (y * 8 + x + 1)), 4) AS digest FROM c WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 GROUP BY image""")
def q115_convolution(spark: SparkSession, folder: str) -> DataFrame:
    return per_image(imaging.convolved(squares(spark, folder), _KERNEL, 8, 8), 8)


@query(f"""WITH b AS (SELECT image, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM {_PIX} WHERE v < 95 GROUP BY image), c AS (SELECT p.image, y - greatest(y0 - 1, 0) AS y, x - greatest(x0 - 1, 0) AS x, v FROM {_PIX} p JOIN b ON p.image = b.image AND y BETWEEN y0 - 1 AND y1 + 1 AND x BETWEEN x0 - 1 AND x1 + 1)
SELECT image, count(*) AS n, round(sum(v::DOUBLE * (y * 8 + x + 1)), 4) AS digest FROM c GROUP BY image""")
def q116_cropped(spark: SparkSession, folder: str) -> DataFrame:
    """The box around the dark pixels, with a margin of one."""
    p = squares(spark, folder)
    return per_image(imaging.cropped(p, p.where("v < 95"), 1), 8)


@query(f"""WITH s AS (SELECT image, (y + 2) AS y, x, v FROM {_PIX} WHERE y < 3), c AS (SELECT i.image, a.y, b.x FROM (SELECT DISTINCT vec_id AS image FROM embeddings) i, range(0, 8) a(y), range(0, 8) b(x)), f AS (SELECT c.image, c.y, c.x, coalesce(s.v, 127) AS v FROM c LEFT JOIN s ON s.image = c.image AND s.y = c.y AND s.x = c.x)
SELECT image, count(*) AS n, round(sum(v::DOUBLE * (y * 8 + x + 1)), 4) AS digest FROM f GROUP BY image""")
def q117_squared(spark: SparkSession, folder: str) -> DataFrame:
    """Pictures of three rows and eight columns, padded to squares."""
    p = squares(spark, folder).where("y < 3")
    sizes = p.select("image").distinct().withColumns({"height": F.lit(3), "width": F.lit(8)})
    return per_image(imaging.squared(p, sizes), 8)


@query(f"""SELECT image, y // 3 AS "row", x // 3 AS "column", count(*) AS n, CAST(sum(v * ((y % 3) * 3 + x % 3 + 1)) AS BIGINT) AS digest FROM {_PIX} GROUP BY ALL""")
def q118_tiles(spark: SparkSession, folder: str) -> DataFrame:
    t = imaging.tiled(squares(spark, folder), 3)
    return t.groupBy("image", "row", "column").agg(F.count("*").alias("n"), F.sum(F.col("v") * (F.col("y") * 3 + F.col("x") + 1)).cast("long").alias("digest"))


_INK = "(SELECT vec_id // 40 AS image, vec_id % 40 AS y, unnest(range(0, 64)) AS x, CAST(floor((unnest(embedding)::DOUBLE + 1) * 127) AS INTEGER) AS v FROM embeddings)"


def sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Forty vectors, one below the other, as a picture 64 wide."""
    p = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
    return p.select(F.floor(F.col("vec_id") / 40).alias("image"), (F.col("vec_id") % 40).alias("y"), "x", F.floor((F.col("e").cast("double") + 1) * 127).cast("int").alias("v"))


def _sizes(p: DataFrame) -> DataFrame:
    return p.select("image").distinct().withColumns({"height": F.lit(40), "width": F.lit(64)})


@query(f"""WITH c AS (SELECT image, x, count(*) FILTER (WHERE v < 127) * 1000 // 40 AS share FROM {_INK} WHERE x >= 25 AND x < 38 GROUP BY ALL), f AS (SELECT image, arg_min(x, (abs(x - 32), x)) AS gutter FROM c WHERE share <= 5 OR share >= 600 GROUP BY image)
SELECT image, CAST(gutter AS INTEGER) AS gutter FROM (SELECT DISTINCT image FROM {_INK}) LEFT JOIN f USING (image)""")
def q119_gutters(spark: SparkSession, folder: str) -> DataFrame:
    """Where a sheet may be cut in two."""
    p = sheets(spark, folder)
    return imaging.gutters(p, _sizes(p), 127)


_COARSE, _FINE = imaging.COARSE, sorted({a + f for a in imaging.COARSE for f in imaging.FINE})
_ANGLES = lambda angles: ", ".join(f"({a!r}::DOUBLE, {math.tan(math.radians(a))!r}::DOUBLE)" for a in angles)
_SCORES = f"""SELECT image, angle, sum(n * n)::DOUBLE / 40 - (sum(n)::DOUBLE / 40) * (sum(n)::DOUBLE / 40) AS score FROM (SELECT image, angle, y - CAST(sign(t * x) * floor(abs(t * x) + 0.5::DOUBLE) AS BIGINT) AS y, count(*) AS n FROM {_INK} i, {{0}} AS a(angle, t) WHERE v < 110 GROUP BY ALL) WHERE y BETWEEN 0 AND 39 GROUP BY ALL"""


@query(f"""WITH a AS ({_SCORES.format(f"(VALUES {_ANGLES(_COARSE)})")}), c AS (SELECT image, arg_max(angle, (score, angle = 0, -angle)) AS coarse FROM a GROUP BY image), b AS ({_SCORES.format(f"(VALUES {_ANGLES(_FINE)})")})
SELECT image, arg_max(angle, (score, angle = coarse, -angle)) AS angle FROM b JOIN c USING (image) WHERE abs(angle - coarse) <= 0.75::DOUBLE GROUP BY image""")
def q120_skew(spark: SparkSession, folder: str) -> DataFrame:
    """The angle at which the rows of a sheet differ most in ink."""
    p = sheets(spark, folder)
    return imaging.skew(p.where("v < 110").select("image", "y", "x"), _sizes(p))


@query(f"{_SCORES.format(f'(VALUES {_ANGLES(_COARSE)})').replace('SELECT image, angle, sum(n * n)', 'SELECT image, round(angle, 4) AS angle, round(sum(n * n)', 1).replace('/ 40) AS score', '/ 40), 6) AS score', 1)}")
def q121_profiles(spark: SparkSession, folder: str) -> DataFrame:
    """Variance of the ink per row at each whole angle."""
    p = sheets(spark, folder)
    return imaging.scores(p.where("v < 110").select("image", "y", "x"), _sizes(p), imaging.COARSE).withColumn("score", F.round("score", 6))


@query("""WITH RECURSIVE c AS (SELECT user_id, list_sort(list(DISTINCT event_id // 3)) AS c FROM events GROUP BY user_id), f AS (SELECT user_id, c, unnest(range(1, len(c) - 3)) AS i FROM c),
g AS (SELECT user_id, i, c[i:i + 4] AS five, (c[i + 4] - c[i]) / 4.0::DOUBLE AS mean FROM f), k AS (SELECT * FROM g WHERE mean >= 2 AND len(list_filter(range(1, 5), lambda j: abs(five[j + 1] - five[j] - mean) > 0.25::DOUBLE * mean)) = 0),
w AS (SELECT user_id, min(i) AS i, 0 AS staff FROM k GROUP BY user_id UNION ALL SELECT w.user_id, min(k.i), any_value(w.staff) + 1 FROM w JOIN k ON k.user_id = w.user_id AND k.i >= w.i + 5 GROUP BY w.user_id)
SELECT w.user_id AS image, CAST(w.staff AS INTEGER) AS staff, array_to_string(k.five, ',') AS lines FROM w JOIN k ON k.user_id = w.user_id AND k.i = w.i""")
def q122_staves(spark: SparkSession, folder: str) -> DataFrame:
    """A user's event numbers as line centres, in groups of five at nearly even distances."""
    centres = table(spark, folder, "events").select(F.col("user_id").alias("image"), F.floor(F.col("event_id") / 3).cast("long").alias("centre")).distinct()
    s = imaging.staves(centres)
    return s.select("image", "staff", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("""WITH w AS (SELECT t, s, greatest(0.0::DOUBLE, 1 - abs(s + 0.5::DOUBLE - (t + 0.5::DOUBLE) * 4) / 4) AS w FROM range(0, 16) a(t), range(0, 64) b(s) WHERE s >= greatest(0, CAST(floor((t + 0.5::DOUBLE) * 4 - 4 + 0.5::DOUBLE) AS BIGINT)) AND s < least(64, CAST(floor((t + 0.5::DOUBLE) * 4 + 4 + 0.5::DOUBLE) AS BIGINT))),
n AS (SELECT t, s, CAST(floor(w / sum(w) OVER (PARTITION BY t) * 4194304 + 0.5::DOUBLE) AS BIGINT) AS w FROM w), p AS (SELECT vec_id, unnest(range(0, 64)) AS s, CAST(floor((unnest(embedding)::DOUBLE + 1) * 127) AS BIGINT) AS v FROM embeddings), r AS (SELECT vec_id, t, (sum(w * v) + 2097152) >> 22 AS v FROM p JOIN n USING (s) GROUP BY ALL)
SELECT vec_id, CAST(sum(least(greatest(v, 0), 255) * (t + 1)) AS BIGINT) AS digest FROM r GROUP BY vec_id""")
def q123_resampled(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as lines of 64 pixels, brought to sixteen with fixed-point weights."""
    v = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127).cast("long"))
    return kernels.resampled_lines(table(spark, folder, "embeddings").select("vec_id", v.alias("v")), "vec_id", "v", 64, 16, "bilinear").groupBy("vec_id").agg(F.sum(F.col("v") * (F.col("t") + 1)).cast("long").alias("digest"))

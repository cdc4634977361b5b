"""Seeded generation of benchmark operations, and their batch execution."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palimpsest.functions.hashing import fnv1a_mod, uniform


def scratch(spark: SparkSession) -> str:
    """A new folder below that of ``spark.checkpoint.dir``, which goes when the application ends; only a local master may do without the setting."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir")
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{at.rstrip('/')}/palimpsest-store-{uuid.uuid4().hex}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    return path.toString()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder of ``spark.checkpoint.dir``; only a local master may do without the setting."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            at = tempfile.mkdtemp(prefix="palimpsest-")
        sc.setCheckpointDir(at)
    return df.checkpoint()


@dataclass(frozen=True)
class YcsbConfig:
    records: int = 10_000
    key_size: int = 16
    value_size: int = 100
    seed: int = 0xDEADBEEF
    scan_length: int = 100


#: Shares of operations by workload.
YCSB = {
    "A": {"read": 0.5, "update": 0.5}, "B": {"read": 0.95, "update": 0.05}, "C": {"read": 1.0}, "D": {"read_latest": 0.95, "insert": 0.05},
    "E": {"scan": 0.95, "insert": 0.05}, "F": {"read": 0.5, "read_modify_write": 0.5},
}
THETA = 0.99
#: Key prefixes of the order benchmark.
KEYS = {"warehouse": "warehouse:%08d", "item": "item:%08d", "stock": "stock:%08d:%08d", "order": "order:%08d:%016d", "order_line": "order_line:%08d:%016d:%04d"}
#: Operations of simulated runs, with weights.
SIM_MIXES = {"default": {"put": 40, "get": 40, "delete": 10, "internal": 10}, "write_heavy": {"put": 60, "get": 20, "delete": 15, "internal": 5}, "read_heavy": {"put": 15, "get": 75, "delete": 5, "internal": 5}, "stress": {"put": 50, "get": 20, "delete": 20, "internal": 10}}


def choose(u, weights: dict[str, float]):
    """A name by cumulative weight of a uniform value."""
    total, upto, out = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        upto += w
        out = F.when(u < upto / total, name) if out is None else out.when(u < upto / total, name)
    return out.otherwise(list(weights)[-1])


def ycsb_key(i, size: int = 16):
    return F.concat(F.lit("user"), F.lpad(i.cast("string"), size - 4, "0"))


def ycsb_load(spark: SparkSession, config: YcsbConfig = YcsbConfig()) -> DataFrame:
    """(k, v): the records before the run."""
    blocks = -(-config.value_size // 64)
    value = F.substring(F.concat(*(F.sha2(F.concat_ws(":", F.lit(str(config.seed)), F.col("id").cast("string"), F.lit(str(b))), 256) for b in range(blocks))), 1, config.value_size)
    return spark.range(config.records).select(ycsb_key(F.col("id"), config.key_size).alias("k"), value.alias("v"))


def zeta(spark: SparkSession, n: int, theta: float = THETA) -> float:
    return spark.range(1, n + 1).agg(F.sum(F.pow(F.col("id").cast("double"), -theta))).first()[0]


def zipfian(u, n: int, zetan: float, theta: float = THETA):
    """Rank from 0 with Zipf weights, by the inverse formula of the benchmark's authors."""
    alpha, second = 1 / (1 - theta), 1 + 0.5**theta
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - second / zetan) if n > 2 else 1.0
    spread = F.floor(n * F.pow(eta * u - eta + 1, alpha))
    return F.when(u * zetan < 1, 0).when(u * zetan < second, 1).otherwise(F.least(spread, F.lit(n - 1))).cast("long")


def ycsb_ops(spark: SparkSession, workload: str, n: int, config: YcsbConfig = YcsbConfig()) -> DataFrame:
    """(i, op, record, k, scan_len): ``n`` operations of a workload, each row from its number and the seed alone.

    Keys follow a scrambled Zipf distribution; ``read_latest`` steps back from
    the newest record by an exponential distance. Inserts are numbered in order,
    by a count per range of operations, so that no single task orders them all.
    """
    seed, r = config.seed, config.records
    base = spark.range(n).select(F.col("id").alias("i"), choose(uniform(seed, F.col("id"), 1), YCSB[workload]).alias("op"), uniform(seed, F.col("id"), 2).alias("u"), uniform(seed, F.col("id"), 3).alias("l"))
    size = 100_000
    base = base.withColumn("part", F.floor(F.col("i") / size))
    newest = F.lit(r)
    if "insert" in YCSB[workload]:
        per = base.groupBy("part").agg(F.count_if(F.col("op") == "insert").alias("c"))
        before = per.select("part", (F.sum("c").over(W.orderBy("part")) - F.col("c")).alias("before"))  # a row for each range
        own = F.sum((F.col("op") == "insert").cast("long")).over(W.partitionBy("part").orderBy("i"))
        base = base.join(F.broadcast(before), "part").withColumn("made", F.col("before") + own)
        newest = F.col("made") + r
    rank = zipfian(F.col("u"), r, zeta(spark, r))
    picked = fnv1a_mod(r)(rank)
    back = F.least(F.floor(-F.ln(F.greatest(F.col("u"), F.lit(1e-12))) * 0.1 * newest), newest - 1)
    record = F.when(F.col("op") == "insert", newest - 1).when(F.col("op") == "read_latest", newest - 1 - back).otherwise(picked).cast("long")
    scan = F.when(F.col("op") == "scan", (F.floor(F.col("l") * 2 * config.scan_length) + 1).cast("int"))
    return base.select("i", "op", record.alias("record"), scan.alias("scan_len")).select("i", "op", "record", ycsb_key(F.col("record"), config.key_size).alias("k"), "scan_len")


def scan_requests(requests: DataFrame, state: DataFrame) -> DataFrame:
    """(req, k, v): for each request (req, start, len) the first ``len`` keys of ``state`` (k, v) from ``start``.

    Keys are numbered. A request finds the number of its first key by the number
    of keys before its start, taken from counts per range and an ordered pass
    inside the range; then each place of its run meets its key by equality.
    """
    from palimpsest.operators.learned import positions

    placed = positions(state.select(F.col("k").cast("binary").alias("k")), cut).withColumn("k", F.col("k").cast("string"))
    keyed = placed.join(state, "k").select("k", "v", "pos")
    ranges = placed.groupBy(F.floor(F.col("pos") / 10_000).alias("part")).agg(F.min("k").alias("low"))
    lows = sorted((r.low, r.part) for r in ranges.collect())  # a row for each 10,000 keys
    if not lows:
        return requests.join(state.limit(0).select("k", "v"), F.lit(False)).select("req", "k", "v")
    edges = F.broadcast(requests.sparkSession.createDataFrame([(part, low, after) for (low, part), after in zip(lows, [x for x, _ in lows[1:]] + [None], strict=True)], "part long, low string, after string"))
    first = lows[0][1]
    asks = requests.join(edges, (F.col("start") >= F.col("low")) & (F.col("after").isNull() | (F.col("start") < F.col("after"))), "left").withColumn("part", F.coalesce("part", F.lit(first)))
    marks = placed.select(F.floor(F.col("pos") / 10_000).alias("part"), F.col("k").alias("x"), F.lit(1).alias("kind"), "pos")
    both = asks.select("part", F.col("start").alias("x"), F.lit(0).alias("kind"), "req", "len").unionByName(marks, allowMissingColumns=True)
    w = W.partitionBy("part").orderBy("x", "kind").rowsBetween(0, W.unboundedFollowing)
    found = both.withColumn("at", F.coalesce(F.first("pos", True).over(w), (F.col("part") + 1) * 10_000)).where("kind = 0")
    runs = found.select("req", F.explode(F.sequence("at", F.col("at") + F.col("len") - 1)).alias("pos"))
    return runs.join(keyed, "pos").select("req", "k", "v")


def tpcc_load(spark: SparkSession, warehouses: int, items: int, seed: int = 7) -> dict[str, DataFrame]:
    w = spark.range(1, warehouses + 1).select(F.col("id").alias("w_id"), F.format_string(KEYS["warehouse"], "id").alias("k"), F.lit(300_000).cast("long").alias("balance"))
    i = spark.range(1, items + 1).select(F.col("id").alias("item_id"), F.format_string(KEYS["item"], "id").alias("k"), (F.floor(uniform(seed, F.col("id")) * 9_901) + 100).cast("long").alias("price"))
    s = w.select("w_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(items).cast("long"))).alias("item_id")).select("w_id", "item_id", F.format_string(KEYS["stock"], "w_id", "item_id").alias("k"), F.lit(100).cast("long").alias("stock"))
    return {"warehouse": w, "item": i, "stock": s}


def new_orders(spark: SparkSession, n: int, warehouses: int, items: int, seed: int = 7) -> DataFrame:
    """(order_id, w_id, line, item_id, quantity): 5 to 10 lines of 1 to 10 pieces; an item may come twice."""
    o = spark.range(1, n + 1).select(F.col("id").alias("order_id"), (F.floor(uniform(seed, F.col("id"), 1) * warehouses) + 1).cast("long").alias("w_id"), (F.floor(uniform(seed, F.col("id"), 2) * 6) + 5).cast("int").alias("n"))
    e = o.select("order_id", "w_id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("line"))
    pick = lambda k, top: (F.floor(uniform(seed, F.col("order_id"), F.col("line"), k) * top) + 1).cast("long")
    return e.select("order_id", "w_id", "line", pick(3, items).alias("item_id"), pick(4, 10).alias("quantity"))


def order_totals(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines, pieces and sum of price x quantity per order, in cents."""
    return lines.join(items.select("item_id", "price"), "item_id").groupBy("order_id").agg(F.count(F.lit(1)).alias("n_items"), F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price")).alias("total"))


def apply_orders(stock: DataFrame, lines: DataFrame) -> DataFrame:
    """Stock after all lines; repeated items add up."""
    by = [c for c in ("w_id", "item_id") if c in stock.columns]
    sold = lines.groupBy(*by).agg(F.sum("quantity").alias("_sold"))
    return stock.join(sold, by, "left").withColumn("stock", F.col("stock") - F.coalesce("_sold", F.lit(0))).drop("_sold")


def stock_invariant(stock: DataFrame, lines: DataFrame, initial: int) -> DataFrame:
    """Per item: what stock lost equals what orders took."""
    gone = stock.groupBy("item_id").agg(F.sum("stock").alias("stock"), F.sum(initial - F.col("stock")).alias("_gone"))
    took = lines.groupBy("item_id").agg(F.sum("quantity").alias("ordered"))
    return gone.join(took, "item_id").select("item_id", "stock", "ordered", (F.col("_gone") == F.col("ordered")).alias("holds"))


def sim_ops(spark: SparkSession, n: int, seed: int, keys: int = 100, mix: str = "default", least: int = 10, most: int = 1024) -> DataFrame:
    """(op_no, op, k, v_len): operations of a simulated run; ``internal`` is a flush or a compaction."""
    op = choose(uniform(seed, F.col("id"), 1), SIM_MIXES[mix])
    inner = F.when(uniform(seed, F.col("op_no"), 4) < 0.5, "flush").otherwise("compact")
    key = F.format_string("k%05d", F.floor(uniform(seed, F.col("id"), 2) * keys).cast("long"))
    size = (F.floor(uniform(seed, F.col("id"), 3) * (most - least + 1)) + least).cast("int")
    df = spark.range(n).select(F.col("id").alias("op_no"), op.alias("op"), key.alias("k"), size.alias("v_len"))
    return df.select("op_no", F.when(F.col("op") == "internal", inner).otherwise(F.col("op")).alias("op"), F.when(F.col("op") != "internal", F.col("k")).alias("k"), F.when(F.col("op") == "put", F.col("v_len")).alias("v_len"))


def operation_batches(ops: DataFrame, size: int) -> DataFrame:
    """(batch, ops): the puts and deletes of each ``size`` operations of :func:`sim_ops`, in order; a batch without any has no row."""
    one = F.struct("op_no", "op", "k", "v_len")
    writes = ops.where(F.col("op").isin("put", "delete"))
    return writes.groupBy(F.floor(F.col("op_no") / size).alias("batch")).agg(F.sort_array(F.collect_list(one)).alias("ops"))  # at most ``size`` in one

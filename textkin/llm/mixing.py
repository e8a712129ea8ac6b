"""Mixing sources to target weights: hierarchical budgeting.

Leaves are (domain, language, source) paths. A budget of tokens flows down the tree: each node's share of its parent's
budget is its weight over its siblings'. A leaf can give at most its tokens times `max_epochs`. What a child can't take is
spread over its siblings that still can, by weight, level by level from below: siblings first, then the parent's
siblings, up to the root. Within a leaf, documents are in a seeded order, another one each epoch, and the prefix is
taken whose tokens come nearest to the leaf's budget.

The tree's rows (a leaf each: path, tokens) come to the driver; their number is the catalogue of sources, not of
documents. Documents are ranked without a task per leaf: the seeded hash cuts a leaf in ranges, whose token sums are
added up first, so a leaf that holds a third of all rows is many tasks.

Null texts have no tokens and are taken with whatever stands at their place; a leaf without a token gives nothing; null
path values are a leaf of their own. A row is drawn once an epoch, and repeated rows are rows of their own. An empty table gives an empty table.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, words, written

#: The order of an epoch: hex digits of md5(seed:epoch:id). Ranges are as many of its first digits as leave about RANGE_ROWS rows
#: of the largest leaf in each, between 2 and 5 digits.
RANGE_ROWS, SEED = 4000, 42
#: The leaves' budgets are broadcast up to so many rows, about 100 bytes each.
BROADCAST_LEAVES = 100_000
PATH = ("domain", "lang", "source")


def spread(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """budget over (weight, capacity) children: by weight, none over its capacity, what one can't take going to its siblings by weight."""
    got, free = [0.0] * len(children), [i for i, (w, cap) in enumerate(children) if w > 0 and cap > 0]
    left = min(budget, sum(children[i][1] for i in free))
    while free and left > 1e-9:
        total = sum(children[i][0] for i in free)
        full = [i for i in free if left * children[i][0] / total >= children[i][1]]
        if not full:
            for i in free:
                got[i] = left * children[i][0] / total
            break
        for i in full:
            got[i] = children[i][1]
        left -= sum(children[i][1] for i in full)
        free = [i for i in free if i not in full]
    return got


def budgets(leaves: list[tuple[tuple, float]], weight, total: float, max_epochs: int) -> dict[tuple, float]:
    """leaf path -> budget. leaves: (path, tokens); weight(prefix): a node's weight among its siblings."""
    capacity: dict[tuple, float] = defaultdict(float)
    below: dict[tuple, set] = defaultdict(set)
    for path, tokens in leaves:
        for k in range(len(path) + 1):
            capacity[path[:k]] += tokens * max_epochs
            if k:
                below[path[: k - 1]].add(path[:k])
    out: dict[tuple, float] = {}

    def down(node: tuple, budget: float) -> None:
        kids = sorted(below.get(node, ()), key=str)
        if not kids:
            out[node] = budget
            return
        # a subtree's capacity bounds its share, so a shortage below goes to this node's other children before it leaves the node
        for kid, share in zip(kids, spread(budget, [(weight(k), capacity[k]) for k in kids]), strict=True):
            down(kid, share)

    down((), min(total, capacity[()]))
    return out


def mix(docs: DataFrame, weight, total_share: float, max_epochs: int = 2, path: tuple[str, ...] = PATH, id_col: str = "doc_id", tokens_col: str = "n_tokens", seed: int = SEED, out: tuple[str, str, str] = ("epoch", "leaf_budget", "tokens_before")) -> DataFrame:
    """docs (with path columns and tokens_col), a row for each time a row is taken, with the epoch, the leaf's budget and the tokens before it.

    These three are called as `out` says; a column of docs of such a name is replaced. The budget is total_share of all tokens.
    Rows equal in id are ordered by a hash of their other columns, and null ids are spread by it."""
    spark = docs.sparkSession
    epoch, leaf_budget, tokens_before = out
    docs = docs.drop(*out)
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in path]
    named = docs.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    ks = [f"_k{i}" for i in range(len(path))]
    tokens = F.coalesce(F.col(tokens_col), F.lit(0))
    leaves = named.groupBy(*ks).agg(F.count("*"), F.sum(tokens)).collect()
    sizes = [(tuple(r[: len(path)]), float(r[-1])) for r in leaves]
    digits = next((k for k in range(2, 5) if max((r[-2] for r in leaves), default=0) <= RANGE_ROWS * 16**k), 5)
    plan = budgets(sizes, weight, total_share * sum(t for _, t in sizes), max_epochs)
    own = dict(sizes)
    rows = [] if not sizes else [(*p, e, float(plan[p] - e * own[p])) for p in plan for e in range(max_epochs) if plan[p] - e * own[p] > 1e-9]
    shape = ", ".join(f"{k} string" for k in ks) + f", `{epoch}` int, `{leaf_budget}` double"
    # a row a leaf and epoch; were it joined by a shuffle on the leaf, a hot leaf would stay in that one partition below
    targets = spark.createDataFrame(rows, shape)
    wanted = named.join(F.broadcast(targets) if len(rows) <= BROADCAST_LEAVES else targets, ks)
    hashed = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    wanted = wanted.withColumn("_row", F.xxhash64(*hashed))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(epoch).cast("string"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null"), F.col("_row").cast("string")))))
    wanted = wanted.withColumn("_order", order).withColumn("_range", F.substring("_order", 1, digits)).withColumn("_tokens", tokens)
    cell = [*ks, epoch, "_range"]
    if len(rows) > BROADCAST_LEAVES:
        wanted = wanted.repartition(*cell)
    sums = wanted.groupBy(*cell).agg(F.sum("_tokens").alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.partitionBy(*ks, epoch).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum("_tokens").over(Window.partitionBy(*cell).orderBy("_order", id_col, "_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = wanted.withColumn("_inside", inside).join(before, cell).withColumn(tokens_before, F.col("_before") + F.col("_inside"))
    return ranked.where(F.col(tokens_before) + F.col("_tokens") / 2 <= F.col(leaf_budget)).drop(*ks, "_row", "_order", "_range", "_tokens", "_inside", "_before")


#: Target weights of the domains, into which sources fall by a hash of their name; languages and sources below weigh as listed, else 1.
DOMAIN_WEIGHTS = {"web": 0.5, "books": 0.3, "code": 0.2}
LANGUAGE_WEIGHTS = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}


def domain_of(source) -> F.Column:
    """A source's domain: by the first hex digit of the md5 of its name."""
    digit = F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)
    return F.when(digit < "8", "web").when(digit < "c", "books").otherwise("code")


def target_weight(node: tuple) -> float:
    if len(node) == 1:
        return DOMAIN_WEIGHTS.get(node[0], 1.0)
    return LANGUAGE_WEIGHTS.get(node[1], 0.1) if len(node) == 2 else 1.0


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all words, at most two epochs of a leaf: (doc_id, epoch, domain, lang, source, n_tokens, tokens_before)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.size(words(F.col("text"))).cast("long").alias("n_tokens"))
    small = written(docs.withColumn("domain", domain_of(F.col("source"))))
    return mix(small, target_weight, 0.5).select("doc_id", "epoch", "domain", "lang", "source", "n_tokens", F.col("tokens_before").cast("long").alias("tokens_before"))

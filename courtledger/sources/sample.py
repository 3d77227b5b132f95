"""League inputs derived from the sample order tables.

An order is a game: the customer's nation is at home, the nation of the lowest
supplier is away, quantities are the home score and prices modulo 50 the away
score. A line item is a box line of its supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from courtledger import schemas
from courtledger.functions.calendar import in_period, period_column

# The league's calendar moved to the years of the orders. It opens after the
# first ones, so some games have no period.
FIRST_YEAR, LAST_YEAR = 1995, 2000


def _season(year: int) -> list[tuple[str, str]]:
    span = f"{year % 100:02d}-{(year + 1) % 100:02d}"
    return [
        (f"season-{span}", f"{year}-10-28"),
        (f"playoff-{span}", f"{year + 1}-04-19"),
        (f"summer-{span}", f"{year + 1}-06-20"),
    ]


MARKERS = [
    marker for year in range(FIRST_YEAR, LAST_YEAR + 1) for marker in _season(year)
] + _season(LAST_YEAR + 1)[:1]


# Given so that opening a table needs no job to infer it.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz",
    "lineitem": (
        "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_tax double"
    ),
    "events": "event_id bigint, ts timestamp_ntz, event_type string, props string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def teams(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation")
    conference = F.when(F.col("n_regionkey") <= 1, "west").otherwise("east")
    return nation.select(F.col("n_name").alias("team"), conference.alias("conference"))


def arenas(spark: SparkSession, folder: str) -> DataFrame:
    """Every nation but one has an arena."""
    nation = table(spark, folder, "nation").where(F.col("n_name") != "NATION_0")
    return nation.select(
        F.col("n_name").alias("team"), F.concat(F.lit("Arena of "), "n_name").alias("arena")
    )


def orders(spark: SparkSession, folder: str, period: str | None = None) -> DataFrame:
    """Orders as (game_id, custkey, game_time, period), a period's by range."""
    game_time = F.col("o_orderdate").cast("timestamp")
    rows = table(spark, folder, "orders")
    if period is not None:
        rows = rows.where(in_period(game_time, period, MARKERS))
    label = F.lit(period) if period is not None else period_column(game_time, MARKERS)
    return rows.select(
        F.col("o_orderkey").alias("game_id"),
        F.col("o_custkey").alias("custkey"),
        game_time.alias("game_time"),
        label.alias("period"),
    )


def _away_points(price: Column) -> Column:
    return F.floor(price) % 50 + 1


def games(spark: SparkSession, folder: str, period: str | None = None) -> DataFrame:
    """One row per order whose two nations differ."""
    scores = [
        F.sum(F.col("l_quantity").cast("bigint")).cast("int").alias("home_score"),
        F.sum(_away_points(F.col("l_extendedprice"))).cast("int").alias("away_score"),
        F.min("l_suppkey").alias("suppkey"),
    ]
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "game_id")
    played = orders(spark, folder, period)
    if period is None:
        scored = played.join(lines.groupBy("game_id").agg(*scores), "game_id")
    else:
        # Of one period only its own line items are aggregated.
        scored = lines.join(played, "game_id").groupBy(*played.columns).agg(*scores)
    return _with_sides(spark, folder, scored).select(
        "game_id", "home_team", "away_team", "home_score", "away_score", "game_time", "period"
    )


def _with_sides(spark: SparkSession, folder: str, played: DataFrame) -> DataFrame:
    """Add home and away team; nations are compared by key before names are joined."""
    return _with_away(spark, folder, _with_home(spark, folder, played))


def _with_home(spark: SparkSession, folder: str, played: DataFrame) -> DataFrame:
    """Add the home nation and its name.

    No broadcast hints: customers and suppliers grow with the data, so Spark
    decides by their size.
    """
    customer = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("home_nation")
    )
    home = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("home_nation"), F.col("n_name").alias("home_team")
    )
    return played.join(customer, "custkey").join(home, "home_nation")


def _with_away(spark: SparkSession, folder: str, played: DataFrame) -> DataFrame:
    """Add the away team where it is another nation than the home team's."""
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("away_nation")
    )
    away = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("away_nation"), F.col("n_name").alias("away_team")
    )
    return (
        played.join(supplier, "suppkey")
        .where(F.col("home_nation") != F.col("away_nation"))
        .join(away, "away_nation")
    )


def box_lines(
    spark: SparkSession, folder: str, period: str | None = None, opponents: bool = False
) -> DataFrame:
    """One line per line item: its supplier played for the supplier's nation."""
    played = orders(spark, folder, period)
    supplier = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("name"),
        F.col("s_nationkey").alias("n_nationkey"),
    )
    nation = table(spark, folder, "nation").select("n_nationkey", F.col("n_name").alias("team"))
    lines = (
        table(spark, folder, "lineitem")
        .join(played, F.col("l_orderkey") == F.col("game_id"))
        .join(supplier, "l_suppkey").join(nation, "n_nationkey")
    )
    shown = []
    if opponents:
        customer = table(spark, folder, "customer").select(
            F.col("c_custkey").alias("custkey"), F.col("c_nationkey").alias("home_nation")
        )
        home = nation.select(
            F.col("n_nationkey").alias("home_nation"), F.col("team").alias("opponent")
        )
        lines = lines.join(customer, "custkey").join(home, "home_nation")
        shown = ["opponent"]
    offreb = F.col("l_linenumber")
    defreb = F.round(F.col("l_tax") * 100).cast("int")
    return lines.select(
        "period", "name", "team", *shown, F.col("game_time").alias("time"),
        F.col("l_quantity").cast("int").alias("pts"),
        offreb.alias("offreb"), defreb.alias("defreb"), (offreb + defreb).alias("totalreb"),
    )


def player_lines(spark: SparkSession, folder: str, period: str | None = None) -> DataFrame:
    """Box lines with all columns of the player table."""
    lines = box_lines(spark, folder, period, opponents=True)
    made = (F.col("pts") / 2).cast("int").cast("string")
    pts = F.col("pts").cast("string")
    extra = {
        "pos": F.lit("G"), "min": F.concat(pts, F.lit(":00")),
        "fgma": F.concat(made, F.lit("-"), pts), "threepma": F.lit("0-0"), "ftma": F.lit("0-0"),
        "minusslashplus": F.concat(F.lit("+"), F.col("defreb").cast("string")),
        "ast": F.col("offreb"), "pf": F.lit(0), "steel": F.col("defreb"), "to0": F.lit(0),
        "blockshoot": F.lit(1), "ba": F.lit(0),
    }
    return lines.withColumns(extra).select(*schemas.PLAYERS.columns)


def journal(spark: SparkSession, folder: str, undecodable: bool = False) -> DataFrame:
    """Journal rows (persistence_id, game_id, game_time, event), the event as JSON.

    A supplier's line items of a game make one box line, summed before the
    shuffle; lines in supplier order alternate between the home and the away box.
    A box is as long as the order has suppliers: one event is one row.

    ``undecodable`` adds a cut-off copy of every payload, and the rows of
    ``events``, whose properties are JSON of another shape.
    """
    quantity = F.col("l_quantity").cast("bigint")
    lines = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("game_id"), "l_suppkey").agg(
        F.sum(quantity).alias("pts"), F.sum("l_linenumber").alias("off"),
        F.sum(F.round(F.col("l_tax") * 100).cast("bigint")).alias("def"),
        F.sum(_away_points(F.col("l_extendedprice"))).alias("away_points"),
    )
    scores = lines.groupBy("game_id").agg(
        F.sum("pts").alias("home_score"), F.sum("away_points").alias("away_score"), F.min("l_suppkey").alias("suppkey"),
        F.sort_array(F.collect_list(F.struct("l_suppkey", "pts", "off", "def"))).alias("lines"),
    )
    # Home teams join the narrow orders: the boxes are dealt out by game once, and not by customer.
    played = _with_away(spark, folder, _with_home(spark, folder, orders(spark, folder)).join(scores, "game_id"))
    event = F.expr(f"""named_struct(
        'teamName', home_team,
        'result', named_struct(
            'homeTeam', home_team, 'homeScore', home_score,
            'awayTeam', away_team, 'awayScore', away_score,
            'time', unix_millis(game_time),
            'homeScoreLine', string(home_score), 'awayScoreLine', string(away_score),
            'homeTotal', named_struct('minutes', 240, 'pts', home_score),
            'awayTotal', named_struct('minutes', 240, 'pts', away_score),
            'homeScoreBox', {_box(side=0)}, 'awayScoreBox', {_box(side=1)}))""")
    payload = F.to_json(event)
    address = [F.col("home_team").alias("persistence_id"), "game_id", "game_time"]
    if not undecodable:
        return played.select(*address, payload.alias("event"))
    both = played.select(*address, payload.alias("whole")).select(
        "persistence_id", "game_id", "game_time",
        F.explode(F.expr("array(whole, left(whole, length(whole) - 9))")).alias("event"),
    )
    props = table(spark, folder, "events").select(
        F.col("event_type").alias("persistence_id"), F.col("event_id").alias("game_id"),
        F.col("ts").cast("timestamp").alias("game_time"), F.col("props").alias("event"),
    )
    return both.unionByName(props)


def _box(side: int) -> str:
    """Every other line, from the first or the second, as SQL."""
    return f"""transform(filter(lines, (x, i) -> i % 2 = {side}), x -> named_struct(
        'name', CASE WHEN x.l_suppkey BETWEEN 0 AND 999999999 THEN concat('Supplier#', lpad(string(x.l_suppkey), 9, '0'))
            ELSE format_string('Supplier#%09d', x.l_suppkey) END, 'pos', 'G', 'pts', x.pts,
        'offReb', x.off, 'defReb', x.def, 'totalReb', x.off + x.def))"""


def game_events(played: DataFrame) -> DataFrame:
    """Games as events without boxes, with instant and period already known."""
    result = F.struct(
        F.col("home_team").alias("homeTeam"), F.col("home_score").alias("homeScore"),
        F.col("away_team").alias("awayTeam"), F.col("away_score").alias("awayScore"),
        F.col("home_score").cast("string").alias("homeScoreLine"),
        F.col("away_score").cast("string").alias("awayScoreLine"),
    )
    return played.withColumn("event", F.struct(result.alias("result"))).withColumn(
        "event_ts", F.col("game_time")
    )

"""Pieces that several of the text operators share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_WORDS_AS_WRITTEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # for texts whose A-Z are still there
BETWEEN_TOKENS = r"[\x20\x09-\x0D]+"
TOKEN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Words of a text in lower case: runs of ASCII digits and letters and of everything beyond ASCII; none for null."""
    parts = F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS)
    return F.array_remove(parts, "")


# The same for texts as UTF-8 bytes: letters in lower case, ASCII that separates words as a blank, the rest as it is.
_WORD_TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32
                    for b in bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode())))


def word_bytes(text: str) -> list[bytes]:
    """The words of ``words`` for use inside tasks."""
    return text.encode("utf-8", "replace").translate(_WORD_TABLE).split()


def text_key(text: Column) -> Column:
    """Tells rows apart that repeat an id with another text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text modulo ``by``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % by


# CRC-32 in the SQL checks: the table by its rule, and the fold over the UTF-8 bytes of a text.
CRC_TABLE_SQL = """crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crcs FROM range(256) r(i))"""


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of ``text``, next to ``crc_table``."""
    codes = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(..)', '0x\\1,', 'g'), ',')[:-2], lambda h: h::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


def free_name(taken: Iterable[str], name: str) -> str:
    """``name`` with as many ``_`` in front as it takes to differ from the names in ``taken``, capitals or not."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


BROADCAST_ROWS = 500_000  # narrow rows: some tens of MB as a hash table


def counted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, narrow rows, written once and counted: broadcast if they are few, so that the texts they are joined with
    stay where they are; otherwise joined in a shuffle."""
    kept = durable(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def components(nodes: DataFrame, links: DataFrame, node: str = "node") -> DataFrame:
    """The smallest node each node reaches: (node, component), one row per distinct node.

    ``links`` has columns ``a`` and ``b``.  Every round hangs each node under the smallest neighbour of its whole
    neighbourhood and then shortens the paths, so rounds grow with the logarithm of the longest chain.  Links stay
    at most as many as given, each round is checkpointed, and nothing but one row of sums per round reaches the driver.
    """
    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())

    edges = links.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    edges = durable(edges.filter("high <> low").distinct())
    before = state(edges)
    while True:
        # Large star: every larger neighbour of a node moves to the smallest of its neighbourhood.
        both = edges.select(F.col("high").alias("n"), F.col("low").alias("m")).union(edges.select("low", "high"))
        least = both.groupBy("n").agg(F.min("m").alias("least"))
        least = least.select("n", F.least("n", "least").alias("least"))
        large = edges.select(F.col("low").alias("n"), "high").join(least, "n").select("high", F.col("least").alias("low"))
        # Small star: every smaller neighbour moves there too.
        smallest = large.groupBy("high").agg(F.min("low").alias("least"))
        moved = large.join(smallest, "high").select(F.col("low").alias("high"), F.col("least").alias("low"))
        edges = durable(moved.filter("high <> low").union(smallest.select("high", "least")).distinct())
        after = state(edges)
        if after == before:  # no edge moved: every node hangs under the smallest one it reaches
            break
        before = after
    roots = edges.select(F.col("high").alias(node), F.col("low").alias("component"))
    found = nodes.select(node).distinct().join(roots, node, "left")
    return found.select(node, F.coalesce("component", node).alias("component"))

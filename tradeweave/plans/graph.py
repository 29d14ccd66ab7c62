"""The payment graph of one data folder: base tables and derived edges.

Base and derived tables are written to the shared folder on first use and read
back by every later report of the same application, as a graph is loaded once
and then queried.  A lost executor therefore never costs more than a rescan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeweave.operators import edges
from tradeweave.operators.network import similarity
from tradeweave.operators.network.betweenness import betweenness
from tradeweave.operators.network.louvain import Communities, louvain
from tradeweave.operators.network.pagerank import PageRank, pagerank
from tradeweave.operators.network.projection import Projection, project_graph
from tradeweave.operators.resolution.blocking import block_candidates
from tradeweave.operators.resolution.scoring import match_entities
from tradeweave.session import expect_compressed_files, write_table
from tradeweave.sources import commerce


class PaymentGraph:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    @cached_property
    def entities(self) -> DataFrame:
        return write_table(commerce.entities(self.spark, self.folder), "entities")

    @cached_property
    def industries(self) -> DataFrame:
        return write_table(commerce.industries(self.spark, self.folder), "industries")

    @cached_property
    def products(self) -> DataFrame:
        return write_table(commerce.products(self.spark, self.folder), "products")

    @cached_property
    def transactions(self) -> DataFrame:
        return write_table(commerce.transactions(self.spark, self.folder), "transactions")

    @cached_property
    def accounts(self) -> DataFrame:
        return write_table(commerce.accounts(self.spark, self.folder, self.transactions), "accounts")

    @cached_property
    def holdings(self) -> DataFrame:
        return write_table(commerce.holdings(self.spark, self.folder), "holdings")

    @cached_property
    def trades(self) -> DataFrame:
        # Sorted inside each file, so a look-up by sender skips most row groups.
        built = edges.trades_with(self.transactions, self.accounts)
        return write_table(built.sortWithinPartitions("src"), "trades")

    @cached_property
    def truth(self) -> DataFrame:
        return commerce.known_twins(self.spark, self.folder)

    @cached_property
    def projection(self) -> Projection:
        return project_graph(self.trades, self.entities)

    @cached_property
    def partner_pairs(self) -> DataFrame:
        return write_table(edges.neighbour_pairs(self.trades), "pairs")

    @cached_property
    def candidates(self) -> DataFrame:
        return write_table(block_candidates(self.entities), "candidates")

    @cached_property
    def matches(self) -> DataFrame:
        return write_table(match_entities(self.entities, self.trades, partners=self.partner_pairs), "matches")

    @cached_property
    def similar(self) -> DataFrame:
        return write_table(similarity.node_similarity(self.partner_pairs), "similar")

    @cached_property
    def page_rank(self) -> PageRank:
        return pagerank(self.projection)

    @cached_property
    def communities(self) -> Communities:
        return louvain(self.projection)

    @cached_property
    def betweenness(self) -> DataFrame:
        return betweenness(self.projection.nodes, self.partner_pairs)

    @cached_property
    def scores(self) -> DataFrame:
        """PageRank, community and betweenness side by side."""
        return (
            self.page_rank.scores.join(self.communities.members, "entity_id", "left")
            .join(self.betweenness, "entity_id", "left")
        )

    @cached_property
    def node_tables(self) -> dict[str, DataFrame]:
        return {
            "Customer": self.entities,
            "Account": self.accounts,
            "Transaction": self.transactions,
            "Industry": self.industries,
            "Product": self.products,
        }

    @cached_property
    def edge_tables(self) -> dict[str, DataFrame]:
        """Relationships after loading; key columns stand for the edges they imply."""
        return {
            "BELONGS_TO": self.entities.where(F.col("sic_code").isNotNull()).select("entity_id", "sic_code"),
            "HAS_ACCOUNT": self.accounts.select("entity_id", "account_id"),
            "HOLDS_PRODUCT": self.holdings,
            "SENT": self.transactions.where(F.col("sender_account_id").isNotNull()),
            "RECEIVED_BY": self.transactions.where(F.col("receiver_account_id").isNotNull()),
            "TRADES_WITH": self.trades,
            "POTENTIAL_MATCH": self.matches,
            "SIMILAR_TO": self.similar,
        }


_open: dict[tuple[str, str], PaymentGraph] = {}


def open_graph(spark: SparkSession, folder: str) -> PaymentGraph:
    """The graph of a folder, shared by all reports of one application."""
    expect_compressed_files(spark)
    key = (spark.sparkContext.applicationId, str(folder).rstrip("/"))
    if key not in _open:
        _open[key] = PaymentGraph(spark, key[1])
    return _open[key]

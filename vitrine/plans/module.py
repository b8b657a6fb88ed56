"""Stored tables to phase data sets: scan, limit, split, mask, sample, batch."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from vitrine.operators import metrics, recommend, reshape, sampling, split, train, validate
from vitrine.schema import FIRST_REAL, T_SPLIT
from vitrine.sources import log as logs


@dataclass
class SlateModule:
    """A slate log with its dictionaries, split into train, valid and test.

    ``folder`` holds the tables ``log`` and ``items`` and the JSON ``vocab``.
    """

    spark: SparkSession
    folder: str
    batch_size: int = 1024
    sample_candidate_items: int = 0
    valid_pct: float = 0.05
    test_pct: float = 0.05
    t_split: int = T_SPLIT
    limit_num_users: int = None
    seed: int = 0
    vocab_whole_file: bool = False
    dims: dict = field(default=None, init=False)

    @property
    def log(self) -> DataFrame:
        log = logs.scan_slate_log(self.spark, f"{self.folder}/log")
        return log if self.limit_num_users is None else reshape.limit_users(log, self.limit_num_users)

    @property
    def items(self) -> DataFrame:
        return logs.scan_item_attr(self.spark, f"{self.folder}/items")

    @property
    def vocab(self) -> DataFrame:
        return logs.scan_vocab(self.spark, f"{self.folder}/vocab", self.vocab_whole_file)

    @property
    def users(self) -> DataFrame:
        return self.log.select("row_idx", "user_id")

    def setup(self) -> "SlateModule":
        """Check the log and keep its sizes; raises on violations."""
        bad = validate.validate_log(self.log).where("violations > 0").collect()
        if bad:
            raise ValueError("unsound log: " + ", ".join(f"{r[0]}={r[1]}" for r in bad))
        self.dims = validate.dataset_dims(self.log, self.vocab).first().asDict()
        return self

    def split_log(self) -> DataFrame:
        return split.split_users_pct(
            self.log, self.users, self.valid_pct, self.test_pct, self.seed)

    def phases(self) -> DataFrame:
        """All phase data sets: wide rows with ``phase`` and ``phase_mask``."""
        return split.phase_mask(self.split_log(), self.t_split)

    def phase(self, name: str) -> DataFrame:
        return self.phases().where(F.col("phase") == name)

    def steps(self) -> DataFrame:
        """Observed interactions with their phase, and negatives if asked for."""
        rows = reshape.explode_interactions(self.split_log()).withColumn(
            "phase", split.phase_of_step(self.t_split))
        if not self.sample_candidate_items:
            return rows
        return sampling.sample_candidates(
            rows, F.lit(self.dims["num_items"]), self.sample_candidate_items, self.seed)

    def batches(self, epoch: int = 0) -> DataFrame:
        users = split.split_users_pct(
            self.users, self.users, self.valid_pct, self.test_pct, self.seed)
        return split.batch_assign(users, self.batch_size, epoch, self.seed)

    def fit(self, dim=9, epochs=100, negatives=4, lr=1e-3):
        """Matrix factorization on the train phase: (users, items, metrics)."""
        real = self.steps().where(F.col("click") >= FIRST_REAL)
        ids = self.items.select(F.col("item_id").cast("bigint").alias("id"))
        return train.mf_fit(
            real, self.users.select(F.col("user_id").alias("id")), ids,
            F.lit(self.dims["num_items"]), dim, epochs, negatives, lr)

    def hitrate(self, users_vec, items_vec, k=10, dist="dot") -> DataFrame:
        """Hit rate of fitted vectors over the test users."""
        def best(users):
            vec = users_vec.withColumnRenamed("id", "user_id").join(users, "user_id")
            return recommend.topk_items(vec, items_vec, k, dist)

        return metrics.hitrate_of(self.split_log(), best, t_split=self.t_split)

"""The normalized tables of a set of payloads."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession

from emberframe.session import new_path


@dataclass(frozen=True)
class ProfileTables:
    """One frame per entity; every frame carries ``payload_id``.

    Tree rows are addressed by ordinals (``rp_idx``, ``sp_idx``, ``p_idx``,
    ``s_idx``, ``pos``), dictionary rows by ``idx``.
    """

    payloads: DataFrame
    resource_profiles: DataFrame
    resource_attributes: DataFrame
    scope_profiles: DataFrame
    scope_attributes: DataFrame
    profiles: DataFrame
    samples: DataFrame
    dict_strings: DataFrame
    dict_mappings: DataFrame
    dict_locations: DataFrame
    dict_functions: DataFrame
    dict_links: DataFrame
    dict_attributes: DataFrame
    dict_stacks: DataFrame

    def with_tables(self, **frames: DataFrame) -> "ProfileTables":
        return replace(self, **frames)

    def save(self, path: str, skip: Sequence[str] = ()) -> None:
        """Write the tables as Parquet below ``path``, a few small jobs at a time."""
        names = [f.name for f in fields(self) if f.name not in skip]
        with ThreadPoolExecutor(max_workers=4) as pool:
            list(pool.map(lambda name: getattr(self, name).write.parquet(f"{path}/{name}"), names))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ProfileTables":
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)})

    def stored(self, label: str, keep: Sequence[str] = ()) -> "ProfileTables":
        """Write the tables to the shared scratch folder once and read them back.

        Tables named in ``keep`` are stored already and stay as they are.
        """
        spark = self.payloads.sparkSession
        path = new_path(spark, label)
        self.save(path, keep)
        names = [f.name for f in fields(self) if f.name not in keep]
        return replace(self, **{
            n: spark.read.schema(getattr(self, n).schema).parquet(f"{path}/{n}") for n in names})

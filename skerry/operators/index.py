"""A searchable collection: a DataFrame with ``_id`` and typed columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans import mapping as mp


@dataclass
class SearchIndex:
    """``df`` has ``_id`` (string, unique) and the mapped columns; text columns may come with their tokens as ``_tok_<field>``.

    ``profile`` is ``flushed`` (idf from the collection) or ``unflushed`` (idf 1 for every term). ``stored`` knows the collection's
    counts from posting lists (``documents``, ``frequencies``, ``averages``), so that no text is read for them.
    """

    df: DataFrame
    mapping: mp.Mapping
    profile: str = "flushed"
    _stats: dict = field(default_factory=dict, repr=False)
    stored: Any = field(default=None, repr=False)

    @staticmethod
    def from_table(df: DataFrame, id_column: str | Column, fields: list[str] | None = None, profile: str = "flushed") -> "SearchIndex":
        """An index over a table; ``fields`` restricts what can be searched (default all columns)."""
        key = F.col(id_column) if isinstance(id_column, str) else id_column
        mapping = mp.from_spark(df.schema)
        if fields is not None:
            mapping = {k: v for k, v in mapping.items() if k in fields}
        return SearchIndex(df.withColumn("_id", key.cast("string")), mapping, profile)

    @property
    def text_fields(self) -> list[str]:
        return sorted(k for k, v in self.mapping.items() if v == mp.KEYWORD)

    def with_tokens(self, fields: list[str]) -> DataFrame:
        """``df`` with the tokens of the fields as columns of their own, so an expression that uses them often splits once."""
        missing = [f for f in fields if f"_tok_{f}" not in self.df.columns]
        return self.df.withColumns({f"_tok_{f}": tx.tokens(F.col(f"`{f}`")) for f in missing}) if missing else self.df

    def materialized(self, path: str) -> "SearchIndex":
        """The same index with its tokens stored beside the columns, as a flush leaves it."""
        kept = ["_id", *self.mapping, *[f"_tok_{f}" for f in self.text_fields]]
        self.with_tokens(self.text_fields).select(*[F.col(f"`{c}`") for c in kept]).write.mode("overwrite").parquet(path)
        return SearchIndex(self.df.sparkSession.read.parquet(path), self.mapping, self.profile)

    def statistics(self, terms: set[str], fields: set[str]) -> "Statistics":
        """Documents, mean lengths and document frequencies, from stored counts or by one aggregation; what is known from earlier calls isn't computed again.

        The document frequency of a term counts the documents that hold it in any text field.
        """
        terms = set() if self.profile == "unflushed" else terms
        new_terms = sorted(t for t in terms if ("df", t) not in self._stats)
        new_fields = sorted(f for f in fields if ("avg", f) not in self._stats)
        if self.stored is not None and (new_terms or new_fields or ("n",) not in self._stats):
            self._stats[("n",)] = self.stored.documents()
            known = self.stored.frequencies(new_terms) if new_terms else {}
            means = self.stored.averages(new_fields) if new_fields else {}
            self._stats.update({("df", t): known.get(t, 0) for t in new_terms} | {("avg", f): means.get(f) for f in new_fields})
        elif new_terms or new_fields or ("n",) not in self._stats:
            every = self.text_fields if new_terms else []
            source = self.with_tokens(sorted(set(new_fields) | set(every)))
            aggs = [F.count(F.lit(1)).alias("n")]
            aggs += [F.avg(F.when(F.col(f"_tok_{f}").isNotNull(), F.size(f"_tok_{f}")).cast("double")).alias(f"a{i}") for i, f in enumerate(new_fields)]
            for i, t in enumerate(new_terms):
                held = F.lit(False)
                for f in every:
                    held = held | F.coalesce(F.array_contains(F.col(f"_tok_{f}"), t), F.lit(False))
                aggs.append(F.count_if(held).alias(f"d{i}"))
            got = source.agg(*aggs).first()
            self._stats[("n",)] = got["n"]
            self._stats.update({("avg", f): got[f"a{i}"] for i, f in enumerate(new_fields)})
            self._stats.update({("df", t): got[f"d{i}"] for i, t in enumerate(new_terms)})
        return Statistics(
            self._stats[("n",)], {t: self._stats[("df", t)] for t in terms}, {f: self._stats[("avg", f)] or 1.0 for f in fields}, self.profile == "unflushed"
        )


@dataclass
class Statistics:
    n: int
    df: dict[str, int]
    average: dict[str, float]
    flat: bool = False

    def idf(self, term: str) -> float:
        return 1.0 if self.flat or term not in self.df else tx.idf(self.df[term], self.n)

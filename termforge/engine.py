"""One object for what a client asks of a set of dictionaries."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termforge import tools
from termforge.functions.udfs import norms
from termforge.operators import analysis, dictionary_jobs, filters, lookup
from termforge.operators import annotate as an
from termforge.sources import export
from termforge.sources.tables import table


@dataclass(frozen=True)
class Engine:
    """Lookups, completion and annotation over tables of entries, dictionaries and tags. Every call is lazy unless it returns Python values."""

    entries: DataFrame
    dictionaries: DataFrame
    entry_tags: DataFrame
    tags: DataFrame
    users: DataFrame | None = None
    semantic: DataFrame | None = None  # vectors of one dictionary
    compiled: DataFrame | None = None  # norms of the entries of all dictionaries, by compile()

    @staticmethod
    def of_folder(spark: SparkSession, folder: str, semantic: str | None = None) -> Engine:
        given = [table(spark, folder, n) for n in ("entries", "dictionaries", "entry_tags", "tags", "users")]
        return Engine(*given, semantic=table(spark, folder, semantic) if semantic else None)

    def scope(self, names: list[str] | None) -> DataFrame:
        """The named dictionaries, or all public ones without names."""
        return lookup.find_dictionaries(self.dictionaries, names).drop("pos").dropDuplicates(["id"]) if names else filters.public(self.dictionaries)

    def labels(self, labels: list[str]) -> DataFrame:
        rows = self.entries.sparkSession.createDataFrame([(x,) for x in labels], "label string")
        return rows.select("label", norms("label").alias("n")).select("label", "n.*")

    def find_ids(self, labels: list[str] | DataFrame, dictionaries: list[str] | None = None, tags: list[str] | None = None, **options) -> DataFrame:
        """(label, identifiers); labels given as a list are normalised here, a table brings its own norms."""
        asked = self.labels(labels) if isinstance(labels, list) else labels
        return lookup.find_ids(asked, self.entries, self.scope(dictionaries), tags=tags, entry_tags=self.entry_tags, tag_table=self.tags, **options)

    def find_terms(self, identifiers: list[str], dictionaries: list[str], verbose: bool = False) -> DataFrame:
        asked = self.entries.sparkSession.createDataFrame([(x,) for x in identifiers], "identifier string")
        return lookup.find_terms(asked, self.entries, self.scope(dictionaries), verbose)

    def complete(self, text: str, dictionary: str, mode: str = "prefix", page: int = 1, per: int = filters.PER_PAGE) -> DataFrame:
        """Entries that complete a text: mode is prefix, substring or mixed."""
        from termforge.functions.text import normalize1 as norm

        run = {"prefix": filters.narrow_by_label_prefix, "substring": filters.narrow_by_label, "mixed": filters.narrow_by_label_mixed}[mode]
        ids = self.scope([dictionary]).select(F.col("id").alias("dictionary_id"))
        return filters.page(run(self.entries.join(ids, "dictionary_id", "left_semi"), norm(text) or ""), page, per)

    def annotate(self, docs: DataFrame, dictionaries: list[str] | None = None, options: an.Options | None = None, **more) -> DataFrame:
        scope = self.scope(dictionaries)
        known = None if self.compiled is None else self.compiled.join(scope.select(F.col("id").alias("dictionary_id")), "dictionary_id", "left_semi")
        return an.annotate(docs, self.entries, scope, options, compiled=known, **more)

    def annotate_texts(self, texts: list[str], dictionaries: list[str] | None = None, options: an.Options | None = None) -> list[dict]:
        """Texts as given, each with its denotations; for a request of a few texts."""
        docs = self.entries.sparkSession.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = {r.doc_id: [d.asDict() for d in r.denotations] for r in self.annotate(docs, dictionaries, options).collect()}
        return [{"text": t, "denotations": found.get(i, [])} for i, t in enumerate(texts)]

    def load(self, path: str, dictionary: str) -> tuple[Engine, dictionary_jobs.Loaded]:
        """A file of entries into an empty dictionary: the engine with them, and what the load did."""
        number = self.scope([dictionary]).first().id
        done = dictionary_jobs.load(self.entries.sparkSession, path, self.entries, self.tags, number)
        grown = [
            old.unionByName(new, allowMissingColumns=True).select(old.columns)
            for old, new in ((self.entries, done.entries), (self.entry_tags, done.entry_tags), (self.tags, done.tags))
        ]
        return replace(self, entries=grown[0], entry_tags=grown[1], tags=grown[2], compiled=None), done

    def export(self, dictionary: str, folder: str, mode: int | None = None, with_operator: bool = False) -> str:
        """A dictionary's entries, of one mode or of all, as tab-separated files written by all tasks; the header line."""
        ids = self.scope([dictionary]).select(F.col("id").alias("dictionary_id"))
        rows = self.entries.join(ids, "dictionary_id", "left_semi")
        rows = rows if mode is None else rows.where(F.col("mode") == mode)
        header, lines = export.entry_lines(rows, self.entry_tags, self.tags, with_operator)
        export.write_lines(header, lines, folder)
        return header

    def compile(self, folder: str | None = None) -> tuple[Engine, dictionary_jobs.Compiled]:
        """The engine with stop words, flags and norms as compiled, so that annotating makes none of them anew; and where the index is."""
        done = dictionary_jobs.compile_dictionaries(self.entries, folder)
        dictionaries = dictionary_jobs.with_stop_words(self.dictionaries, done.stop_words)
        known = an.compiled_entries(done.entries, dictionaries)
        known.write.mode("overwrite").parquet(f"{done.folder}/entries")
        known = self.entries.sparkSession.read.schema(known.schema).parquet(f"{done.folder}/entries")
        return replace(self, entries=done.entries, dictionaries=dictionaries, compiled=known), done

    @property
    def analyze(self) -> Analysis:
        if self.semantic is None:
            raise ValueError("the engine has no table of vectors")
        return Analysis(self.semantic)

    def tool(self, name: str, arguments: dict) -> str:
        """The text that one of the agents' tools gives; respond() of termforge.tools is the protocol around it."""
        if name not in tools.TOOLS:
            raise ValueError(f"unknown tool: {name}")
        return tools.TOOLS[name][3](self, arguments)


@dataclass(frozen=True)
class Analysis:
    """Analytics of one dictionary's vectors. Origins are (no, term, vec) rows, such as embedded general terms."""

    semantic: DataFrame
    dim: int = 64

    @property
    def vectors(self) -> DataFrame:
        return analysis.searchable_vectors(self.semantic, self.dim)

    def centroid(self) -> DataFrame:
        return analysis.centroid_stats(self.vectors, self.dim)

    def clusters(self, least: int = 3) -> DataFrame:
        return analysis.cluster_distances(self.vectors, least, self.dim)

    def local_outliers(self, least: int = 3, z_most: float = 2.0) -> DataFrame:
        return analysis.local_outliers(self.vectors, least, z_most, self.dim)

    def origin_outliers(self, origins: DataFrame, below: float = 0.75, limit: int | None = None) -> DataFrame:
        return analysis.origin_outliers(self.vectors, origins, below, limit)

    def similar(self, ids: list[int], limit: int = 10, other_identifiers: bool = False) -> DataFrame:
        return analysis.similar_entries(self.vectors, self.vectors.where(F.col("id").isin(ids)), limit, other_identifiers)

    def leave_one_out(self, n: int = 1000, least: int = 2) -> DataFrame:
        return analysis.leave_one_out(self.vectors, analysis.sample(self.vectors, n), least)[1]

    def clean_by_origin(self, origins: DataFrame, below: float = 0.75, dry_run: bool = True) -> analysis.Cleaned:
        return analysis.clean_by_origin(self.semantic, origins, self.dim, below, dry_run)

    def clean_two_stage(self, origins: DataFrame, below: float = 0.75, z_most: float = 2.0, least: int = 3, dry_run: bool = True) -> analysis.Cleaned:
        return analysis.clean_two_stage(self.semantic, origins, self.dim, below, z_most, least, dry_run)

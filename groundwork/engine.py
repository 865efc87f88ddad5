"""The engine: one lazy bundle of DataFrames for any number of responses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import attribution, citations, claims, verification
from .options import CiteOptions
from .sources.tables import written


@dataclass(frozen=True)
class CitationReport:
    """Everything about a batch of responses, keyed by response_id; nothing runs until it is asked for."""

    citations: DataFrame
    claims: DataFrame
    attributions: DataFrame
    verifications: DataFrame
    scores: DataFrame
    responses: DataFrame
    extracted: DataFrame
    options: CiteOptions

    def kept(self) -> "CitationReport":
        """The same report with citations, claims and attributions computed now, once, and written to the checkpoint
        folder, so that what follows from them scores nothing again."""
        found, said, scored = (written(df) for df in (self.citations, self.extracted, self.attributions))
        return _report(self.responses, found, said, scored, self.options)

    @property
    def attributed(self) -> DataFrame:
        return self.claims.where("is_factual and is_grounded")

    @property
    def unattributed(self) -> DataFrame:
        return self.claims.where("is_factual and not is_grounded")

    @property
    def misattributed(self) -> DataFrame:
        return self.verifications.where("state = 'misattributed'")

    @property
    def phantom(self) -> DataFrame:
        return self.verifications.where("state = 'phantom'")

    def to_json(self) -> DataFrame:
        """(response_id, report): scores, claims and verifications of a response as one JSON text."""
        nest = lambda df, name, order: df.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in ("response_id", *order))))).alias(name))
        out = self.scores.select("response_id", F.struct(*(c for c in self.scores.columns if c != "response_id")).alias("scores"))
        out = out.join(nest(self.claims, "claims", ["claim_idx"]), "response_id", "left").join(nest(self.citations, "citations", ["cit_idx"]), "response_id", "left")
        checks = self.verifications.withColumn("correct_sources", F.to_json("correct_sources"))
        out = out.join(nest(checks, "verifications", ["claim_idx", "cit_idx"]), "response_id", "left")
        return out.select("response_id", F.to_json(F.struct("scores", "claims", "citations", "verifications")).alias("report"))


def cite(responses: DataFrame, sources: DataFrame, options: CiteOptions = CiteOptions()) -> CitationReport:
    """The report of responses(response_id, response) against sources(response_id, source_pos, source_id, content[,
    metadata, embedding]).

    Where both have a column corpus_id, sources belong to a corpus that many responses share, and are prepared once
    for all of them. A response_id is one response, source_pos counts a response's sources from 1; null texts count as
    empty. Other columns are ignored. Nothing runs before it is asked for; `kept` writes the scores once.
    """
    key = "corpus_id" if "corpus_id" in responses.columns and "corpus_id" in sources.columns else "response_id"
    member = responses.select("response_id", "corpus_id") if key == "corpus_id" else None
    keyed = lambda df: df if member is None else df.join(member, "response_id")
    parsed, said = citations.parse(responses, options), claims.extract(responses, options.claim_granularity)
    found = citations.resolve(keyed(parsed), sources, options, key).drop("corpus_id")
    scored = attribution.score(keyed(said.where("is_factual")), sources, options, key)
    return _report(responses, found, said, scored, options)


def _report(responses, found, said, scored, options) -> CitationReport:
    checks = verification.verify(said, found, scored, options)
    reports = verification.claim_reports(said, found, scored, options)
    return CitationReport(found, reports, scored, checks, verification.response_scores(responses, reports, checks, found, options), responses, said, options)


verify = cite


def attribute(responses: DataFrame, sources: DataFrame, options: CiteOptions = CiteOptions()) -> tuple[DataFrame, CitationReport]:
    """The annotated responses, and the report of the original ones."""
    report = cite(responses, sources, options)
    return verification.annotate(responses, report.claims), report


@dataclass(frozen=True)
class Citer:
    """An engine with preset options; overrides replace whole options."""

    options: CiteOptions = CiteOptions()

    def cite(self, responses: DataFrame, sources: DataFrame, **overrides) -> CitationReport:
        return cite(responses, sources, self.options.with_overrides(**overrides))

    verify = cite

    def attribute(self, responses: DataFrame, sources: DataFrame, **overrides) -> tuple[DataFrame, CitationReport]:
        return attribute(responses, sources, self.options.with_overrides(**overrides))

    def extract_citations(self, responses: DataFrame) -> DataFrame:
        """Citations without sources: none is resolved."""
        out = citations.parse(responses, self.options)
        return out.withColumn("resolved_pos", F.lit(None).cast("long")).withColumn("resolved_id", F.lit(None).cast("string"))

    def extract_claims(self, responses: DataFrame) -> DataFrame:
        return claims.extract(responses, self.options.claim_granularity)


def create_citer(options: CiteOptions = CiteOptions()) -> Citer:
    return Citer(options)

"""All relations of a corpus, each built when it is asked for, from shared plans."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.operators import dimensions, events, links, report, scans, segments, timeml


def _settled(df: DataFrame) -> DataFrame:
    """The same rows, computed now: a checkpoint where a folder is set for them, so that lost executors don't lose it."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


class Corpus:
    """Relations of documents (doc_id, text, language). Ask for one and only what it needs is planned.

    keep: keep events and segments on the executors, which pays when several relations are used, until :meth:`release` or the end of a ``with`` block.
    parts: cut documents in parts of so many sentences, so that a document may be larger than a task (:mod:`storyloom.operators.scans`); events and
    segments are then made part by part, and what is read more than once is held until :meth:`release`. The relations are the same.
    as_cut: clauses lie where they were cut from, not where they are first found (:func:`storyloom.operators.events.clauses`).
    category_model, type_model: optional models of :mod:`storyloom.operators.models`; without them rules alone decide.
    """

    def __init__(self, df: DataFrame, doc_id: str = "doc_id", text: str = "text", language: str | None = "language", keep: bool = False, category_model=None, type_model=None, parts: int | None = None, as_cut: bool = False) -> None:
        self.documents = events.documents(df, doc_id, text, language)
        self._keep, self._category_model, self._type_model, self._parts, self._as_cut = keep, category_model, type_model, parts, as_cut
        self._kept: list[DataFrame] = []

    @classmethod
    def of_sentences(cls, sentences: DataFrame, **options) -> Corpus:
        """A corpus of documents that come as sentences (doc_id, lang, sent_no, sentence, start), for texts too large for a row; its documents have no text. Places have the type of start."""
        docs = sentences.groupBy("doc_id").agg(F.lit("").alias("text"), F.min("lang").alias("language"))
        corpus = cls(docs, **options)
        corpus.__dict__["sentences"] = sentences
        return corpus

    def _hold(self, df: DataFrame) -> DataFrame:
        self._kept.append(df.persist())
        return df

    def _held(self, df: DataFrame) -> DataFrame:
        return self._hold(df) if self._keep else df

    def hold(self, *names: str) -> Corpus:
        """This corpus, which keeps the relations of these names on the executors until :meth:`release`; others are made of them."""
        for name in names:
            self.__dict__[name] = self._hold(getattr(self, name))
        return self

    def settled(self) -> Corpus:
        """This corpus with documents, events, segments and analysis computed here and now, each once, and held without the plans that made them.

        Every other relation is made of these, so a rendering that unites all of them has a plan of its own steps alone; with keep each of its parts repeats the plan of the
        events, which takes longer to analyse than to run. They are kept in the checkpoint folder, or on the executors if none is set, for as long as something is made of them.
        """
        put = self.__dict__
        self.documents = _settled(self.documents)
        put["identified_events"] = _settled(dimensions.place_ids(dimensions.event_actor_ids(self._parted.drop("part") if self._parts else self._made_events)))
        put["events"] = self.identified_events.select(*events.COLUMNS)
        put["identified_segments"] = put["segments"] = put["located_segments"] = _settled(self._segments(self._with_parts(self.identified_events)))
        put["analysis"] = _settled(self.analysis)
        return self

    def release(self) -> None:
        """Frees what is held; relations are computed anew after that."""
        while self._kept:
            self._kept.pop().unpersist()

    def __enter__(self) -> Corpus:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    @cached_property
    def sentences(self) -> DataFrame:
        return events.sentences(self.documents)

    @cached_property
    def features(self) -> DataFrame:
        """Clauses that are events, with what they say by themselves."""
        return events.features(events.event_clauses(events.clauses(self.sentences, self._as_cut)))

    @cached_property
    def _parted(self) -> DataFrame:
        return self._hold(events.classified(scans.numbered(self._hold(self.features), self._parts), self._category_model))

    @cached_property
    def events(self) -> DataFrame:
        if self._keep and not self._parts:
            return self.identified_events.select(*events.COLUMNS)  # held once, with their ids
        return self._held(self._parted.drop("part")) if self._parts else self._made_events

    @cached_property
    def _made_events(self) -> DataFrame:
        return events.classified(events.numbered(self.features), self._category_model)

    def _segments(self, of: DataFrame) -> DataFrame:
        return scans.segments_of(of, self._type_model, self._parts, self._hold) if self._parts else segments.segments(of, self._type_model)

    @cached_property
    def identified_events(self) -> DataFrame:
        """Events with actor_ids and place_id, as the dimensions number them; place_id is null where the location isn't in the dimension."""
        return self._held(dimensions.place_ids(dimensions.event_actor_ids(self.events if self._parts else self._made_events)))

    @cached_property
    def identified_segments(self) -> DataFrame:
        """Segments with actor_ids and location_id."""
        return self._held(self._segments(self._with_parts(self.identified_events)))

    @cached_property
    def segments(self) -> DataFrame:
        return self.identified_segments if self._keep else self._segments(self._parted if self._parts else self.events)

    def _with_parts(self, rows: DataFrame) -> DataFrame:
        """Events with the parts they belong to, if documents are cut."""
        return rows.join(self._parted.select("doc_id", "order", "part"), ["doc_id", "order"]) if self._parts else rows

    @cached_property
    def chain(self) -> DataFrame:
        return links.chained(self.segments)

    @cached_property
    def relations(self) -> DataFrame:
        return links.relations(self.chain)

    @cached_property
    def boundaries(self) -> DataFrame:
        return links.boundaries(self.chain)

    @cached_property
    def endpoints(self) -> DataFrame:
        return links.endpoints(self.chain)

    @cached_property
    def tracks(self) -> DataFrame:
        return links.tracks(self.chain)

    @cached_property
    def actors(self) -> DataFrame:
        return dimensions.actors(self.documents, self.events)

    @cached_property
    def locations(self) -> DataFrame:
        return dimensions.locations(self.documents, self.events)

    @cached_property
    def mentions(self) -> DataFrame:
        return dimensions.mentions(self.events)

    @cached_property
    def located_segments(self) -> DataFrame:
        """Segments with location_id, empty where the location isn't in the dimension."""
        return self.identified_segments if self._keep else self._segments(dimensions.place_ids(self._parted if self._parts else self.events))

    @cached_property
    def tml_events(self) -> DataFrame:
        return timeml.tml_events(self.events)

    @cached_property
    def makeinstances(self) -> DataFrame:
        return timeml.makeinstances(self.events)

    @cached_property
    def timex3(self) -> DataFrame:
        return timeml.timex3(self.events)

    @cached_property
    def signals(self) -> DataFrame:
        return timeml.signals(self.events)

    @cached_property
    def tlinks(self) -> DataFrame:
        return timeml.tlinks(self.events)

    @cached_property
    def analysis(self) -> DataFrame:
        return self._held(report.analysis(self.documents, self.events, self.segments, self.tracks, self.relations, self.mentions, self.tml_events, self.timex3, self.tlinks))

    @cached_property
    def issues(self) -> DataFrame:
        return report.issues(self.analysis)

    @cached_property
    def warnings(self) -> DataFrame:
        return report.warnings(self.documents, self.analysis, self.issues)

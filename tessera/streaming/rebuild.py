"""An index that follows a stream of changed sources: each micro-batch is one incremental rebuild."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as T
from ..operators import chunk, embed, segments
from ..operators import manifest as M


def follow(changes: DataFrame, store: M.Store | segments.SegmentStore, header: M.Header, checkpoint: str, available_now: bool = True, embedder: embed.Embedder | None = None) -> StreamingQuery:
    """changes: (source_key, source_value, text, ord) of new texts; a null text removes its source.

    A batch only compares the keys it names, so sources that it doesn't name stay as they are; of several rows for a key
    the one with the largest ord counts.  A batch that was published but not committed is applied again without effect.

    A SegmentStore gets a segment of what the batch changed, with vectors by the embedder; a Store gets its whole chunk table anew.
    """

    def step(batch: DataFrame, _: int) -> None:
        last = batch.groupBy(*M.KEY).agg(F.max_by(F.struct("text", "ord"), "ord").alias("x")).select(*M.KEY, "x.text", "x.ord").persist()
        try:
            now = last.where("text IS NOT NULL").withColumns({"fingerprint": T.fingerprint(F.col("text")), "chunk_count": chunk.chunk_count(F.col("text"), *header.cut)})
            if isinstance(store, segments.SegmentStore):
                segments.update(store, now.drop("fingerprint", "chunk_count"), last.limit(0).select(*M.KEY), header, embedder, named=last)
                return
            if store.header() is None:
                store.publish(M.chunks_of(now, *header.cut), now.select(*M.KEY, "fingerprint", "chunk_count", F.lit(1).alias("late"), "ord"), header)
                return
            before = store.read("manifest")
            named = before.join(last.select(*M.KEY), M.KEY, "left_semi")
            compared = M.diff(named, now, last.limit(0).select(*M.KEY)).persist()
            if not M.summary(compared).first()["nothing_to_do"]:
                others = before.join(last.select(*M.KEY), M.KEY, "left_anti").select(*M.KEY, "fingerprint", "chunk_count", "late", "ord")
                store.publish(M.apply_to_chunks(store.read("chunks"), compared, now, *header.cut), others.unionByName(M.apply_to_manifest(named, compared, now)), header)
            compared.unpersist()
        finally:
            last.unpersist()

    writer = changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()

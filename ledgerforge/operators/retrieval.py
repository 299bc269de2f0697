"""Chunks of documents and nearest neighbours within a group: T1, T2, M1, M2, J9."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP, K = 500, 50, 4
#: Parts in which the chunks of every group meet questions and are ranked.
SALTS = 32
NOTHING = "No relevant information was found."


#: Characters in which a text is held while it is walked through, so that windows are cut from short strings.
BLOCK = 1 << 16


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", tag_col: str = "source") -> DataFrame:
    """(id, tag, chunk_index, chunk_text): greedy pieces of at most `size` characters.

    A piece ends behind the last paragraph mark, else line end, else blank in the second half of
    its window, else at the window's end; the next one begins `overlap` characters earlier. A fold
    walks from piece to piece and keeps their places.
    """
    half = size // 2
    n = F.char_length("text")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.substring(F.col("text"), k * BLOCK + 1, F.lit(BLOCK)))
    held = docs.filter(n > 0).select(id_col, tag_col, "text", n.cast("int").alias("_n")).withColumn("_blocks", blocks).drop("text")

    def window(at: Column) -> Column:
        k = F.floor(at / BLOCK).cast("int")
        return F.substring(F.concat(F.get("_blocks", k), F.coalesce(F.get("_blocks", k + 1), F.lit(""))), at % BLOCK + 1, F.lit(size))

    def end(at: Column) -> Column:
        tail = F.substring(window(at), half + 1, size - half)
        found = [F.char_length(F.regexp_extract(tail, f"(?s)^(.*{mark})", 1)) for mark in ("\n\n", "\n", " ")]
        cut = F.coalesce(*[F.when(length > 0, at + half + length) for length in found], at + size)
        return F.when(at + size >= F.col("_n"), F.col("_n")).otherwise(cut)

    def step(state: Column, _: Column) -> Column:
        def after(to: Column) -> Column:
            places = F.array_append(state["places"], F.struct(state["at"].alias("at"), to.alias("to")))
            following = F.when(to == F.col("_n"), F.lit(-1)).otherwise(F.greatest(state["at"] + 1, to - overlap))
            return F.struct(following.alias("at"), places.alias("places"))

        return F.when(state["at"] < 0, state).otherwise(F.transform(F.array(end(state["at"])), after)[0])

    none = F.array().cast("array<struct<at: int, to: int>>")
    least = max(1, half + 1 - overlap)  # so far every piece goes beyond the one before, at least
    steps = F.sequence(F.lit(0), F.floor(F.col("_n") / least).cast("int"))
    places = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("places")), step, lambda s: s["places"])
    pieces = held.withColumn("_places", places).select(id_col, tag_col, "_blocks", F.posexplode("_places").alias("chunk_index", "_p"))
    return pieces.select(id_col, tag_col, "chunk_index", F.substring(window(F.col("_p.at")), F.lit(1), F.col("_p.to") - F.col("_p.at")).alias("chunk_text"))


def chunk_fixed(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", tag_col: str = "source") -> DataFrame:
    """T1 without a UDF: windows of `size` characters every `size - overlap`."""
    n = F.char_length("text")
    starts = F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(size - overlap))
    pieces = F.transform(starts, lambda at: F.substring(F.col("text"), at, F.lit(size)))
    return docs.filter(n > 0).select(id_col, tag_col, F.posexplode(pieces).alias("chunk_index", "chunk_text"))


def top_k(questions: DataFrame, chunks: DataFrame, group: str, k: int = K) -> DataFrame:
    """The k chunks nearest to each question within its group, by Euclidean distance.

    Questions (few beside the chunks) are repeated for each salt and meet the chunks of
    their group and that salt, so a group that holds most chunks is dealt over many tasks.
    Each salt keeps its own k best before the final ranking. Ties go by chunk id.
    """
    salt = F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    q = questions.select(F.col("question_id"), group, F.col("embedding").alias("_q"), every.alias("_salt"))
    pairs = chunks.select("chunk_id", group, F.col("embedding").alias("_c"), salt.alias("_salt")).join(q, [group, "_salt"])
    square = F.aggregate(F.zip_with("_q", "_c", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)
    scored = pairs.select("question_id", group, "chunk_id", F.sqrt(square).alias("distance"), "_salt")
    part = Window.partitionBy("question_id", "_salt").orderBy("distance", "chunk_id")
    best = scored.withColumn("_n", F.row_number().over(part)).filter(F.col("_n") <= k)
    whole = Window.partitionBy("question_id").orderBy("distance", "chunk_id")
    return best.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k).select("question_id", group, "rank", "chunk_id", "distance")


def context(hits: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """M2: the texts of a question's hits joined by blank lines; a fixed text where it has none."""
    texts = hits.join(chunks.select("chunk_id", "chunk_text"), "chunk_id").groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_text"))).alias("_hits"))
    joined = F.array_join(F.transform("_hits", lambda h: h["chunk_text"]), "\n\n")
    return questions.select("question_id").join(texts, "question_id", "left").select("question_id", F.coalesce(joined, F.lit(NOTHING)).alias("context"))

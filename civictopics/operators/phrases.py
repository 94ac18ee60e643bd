"""Seed phrases of several words, found in texts and counted like words.

The phrases form an Aho-Corasick automaton over tokens, and each text goes through it once, however many
phrases there are and however they overlap.  Only tokens that are part of a phrase move the automaton;
all others lead back to its root.  The automaton goes to the tasks, so its size is checked: beyond
``AUTOMATON_WORDS`` the phrases are looked up by a join on n-grams instead.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civictopics.functions import text as tx

# Words of all phrases together that an automaton may have.
AUTOMATON_WORDS = 1_000_000
# Texts that a task works on at a time.
ROWS_AT_A_TIME = 512


class TokenAutomaton:
    """States are prefixes of phrases; each knows where a token leads and which phrases end in it."""

    def __init__(self, phrases: list[tuple[str, ...]]):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[tuple[str, ...]] = [()]
        for phrase in phrases:
            state = 0
            for token in phrase:
                if token not in self.next[state]:
                    self.next[state][token] = len(self.next)
                    self.next.append({})
                    self.ends.append(())
                state = self.next[state][token]
            self.ends[state] = (" ".join(phrase),)
        # The longest proper suffix of a state that is a state, in order of length.
        self.back = [0] * len(self.next)
        waiting = deque(self.next[0].values())
        while waiting:
            state = waiting.popleft()
            for token, after in self.next[state].items():
                waiting.append(after)
                self.back[after] = self.step(self.back[state], token)
                self.ends[after] += self.ends[self.back[after]]
        self.tokens = {token for edges in self.next for token in edges}

    def step(self, state: int, token: str) -> int:
        while token not in self.next[state]:
            if state == 0:
                return 0
            state = self.back[state]
        return self.next[state][token]

    def found(self, tokens: list[str]) -> list[str]:
        """Every occurrence of a phrase, by where it ends, longer ones first."""
        state, out = 0, []
        for token in tokens:
            state = self.step(state, token)
            out += self.ends[state]
        return out


def seed_phrases(seeds: DataFrame, seed_col: str = "seed") -> DataFrame:
    """``(word, words)``: distinct seeds of two words or more, joined by spaces, and their words."""
    words = tx.model_tokens(F.col(seed_col))
    return (
        seeds.filter(F.col(seed_col).isNotNull()).select(words.alias("words")).filter(F.size("words") > 1)
        .select(F.array_join("words", " ").alias("word"), "words").distinct()
    )


def _by_automaton(df: DataFrame, phrases: DataFrame, tokens_col: str) -> DataFrame:
    automaton = df.sparkSession.sparkContext.broadcast(TokenAutomaton([tuple(r["words"]) for r in phrases.collect()]))
    schema = T.StructType([*df.schema.fields, T.StructField("phrases", T.ArrayType(T.StringType()))])
    place = df.columns.index(tokens_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton.value
        known = pa.array(sorted(machine.tokens), pa.string())
        for batch in (whole.slice(lo, ROWS_AT_A_TIME) for whole in batches for lo in range(0, whole.num_rows, ROWS_AT_A_TIME)):
            tokens = batch.column(place)
            flat = tokens.flatten()
            # Texts without two tokens of phrases next to each other are passed over.
            part = pc.is_in(flat, value_set=known).to_numpy(zero_copy_only=False)
            lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
            row = np.repeat(np.arange(len(tokens)), lengths)
            beside = part[1:] & part[:-1] & (row[1:] == row[:-1])
            found = [[] if length is not None else None for length in pc.list_value_length(tokens).to_pylist()]
            for k in np.unique(row[1:][beside]).tolist():
                found[k] = machine.found(tokens[k].as_py())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.string()))], names=schema.names)

    return df.mapInArrow(run, schema)


def _by_join(df: DataFrame, phrases: DataFrame, tokens_col: str, id_col: str) -> DataFrame:
    sizes = [r[0] for r in phrases.select(F.size("words")).distinct().collect()]
    grams = F.concat(*[tx.ngrams(F.col(tokens_col), n, n) for n in sorted(sizes)]) if sizes else F.array().cast("array<string>")
    placed = df.select(id_col, F.posexplode(grams).alias("at", "word")).join(phrases.select("word"), "word", "left_semi")
    found = placed.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("placed"))
    none = F.array().cast("array<string>")
    return df.join(found.select(id_col, F.col("placed.word").alias("phrases")), id_col, "left").select(
        *df.columns, F.when(F.col(tokens_col).isNotNull(), F.coalesce("phrases", none)).alias("phrases")
    )


def find_phrases(
    df: DataFrame, phrases: DataFrame, tokens_col: str = "tokens", id_col: str = "row_id", most_words: int = AUTOMATON_WORDS
) -> DataFrame:
    """Adds ``phrases``: every occurrence in ``tokens_col`` of a phrase of ``phrases (word, words)``.

    Occurrences may overlap.  Null tokens give null, no occurrence an empty list.  The join, which
    takes over when the phrases have more than ``most_words`` words, needs ``id_col`` to be a key.
    """
    rest = df.select(*[c for c in df.columns if c != "phrases"])
    words = phrases.agg(F.sum(F.size("words"))).first()[0] or 0
    if words <= most_words:
        return _by_automaton(rest, phrases, tokens_col)
    return _by_join(rest, phrases, tokens_col, id_col)


def with_phrases(df: DataFrame, phrases: DataFrame, tokens_col: str = "tokens", id_col: str = "row_id") -> DataFrame:
    """Phrases that occur in a text join its tokens, so that they get counts and weights like words."""
    found = find_phrases(df, phrases, tokens_col, id_col)
    return found.withColumn(tokens_col, F.concat(tokens_col, "phrases")).select(*df.columns)


def seed_terms(seeds: DataFrame, seed_col: str = "seed") -> DataFrame:
    """``(word)``: the single words of all seeds, and the seeds of several words as phrases."""
    words = seeds.select(F.explode(tx.model_tokens(F.col(seed_col))).alias("word"))
    return words.unionByName(seed_phrases(seeds, seed_col).select("word")).distinct()

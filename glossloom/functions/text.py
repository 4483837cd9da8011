"""Label, path and key expressions. Every function maps columns to a column."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from glossloom import fixed


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def map_lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Small constant map as a CASE expression (stays inside code generation)."""
    if not mapping:
        return default if default is not None else F.lit(None).cast("string")
    out = None
    for k, v in mapping.items():
        cond = key == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out.otherwise(default) if default is not None else out


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_label(c: Column, nfkc: bool = True, aliases: dict[str, str] | None = None) -> Column:
    """Unicode-folded, lower-case label with single spaces; known spellings are merged."""
    aliases = fixed.LABEL_ALIASES if aliases is None else aliases
    t = F.coalesce(c.cast("string"), F.lit(""))
    t = F.lower(F.trim(_nfkc(t) if nfkc else t))
    t = F.translate(t, "_-/", "   ")
    t = collapse_spaces(F.regexp_replace(t, r"(?U)[^\w\s]", " "))
    return map_lookup(aliases, F.replace(t, F.lit(" "), F.lit("")), t)


def normalize_plain(c: Column) -> Column:
    """The older label normaliser: no Unicode folding, no alias merge."""
    t = F.translate(F.lower(F.trim(c)), "_-", "  ")
    return collapse_spaces(F.regexp_replace(t, r"(?U)[^\w\s]", " "))


def folder_name(c: Column, nfkc: bool = True) -> Column:
    return F.replace(normalize_label(c, nfkc), F.lit(" "), F.lit("_"))


def normalize_gloss(c: Column) -> Column:
    """Canonical gloss: index prefix and closing bracket dropped, [a-z0-9' ] kept."""
    t = F.trim(c.cast("string"))
    t = F.regexp_replace(t, r"^\d+\s*[.)]\s*", "")
    t = F.regexp_replace(t, r"\s*\([^)]*\)\s*$", "")
    t = F.lower(F.replace(t, F.lit("_"), F.lit(" ")))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9' ]+", " "), r"\s+", " "))


def strip_index(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^\d+\.\s*", ""))


def token(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """Name without its last ending; a leading dot does not start an ending."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def has_ending(path: Column, endings: tuple[str, ...] = fixed.CLIP_ENDINGS) -> Column:
    return F.lower(path).rlike(r"\.(" + "|".join(endings) + ")$")


def clip_counter(path: Column) -> Column:
    """Camera counter in a file path, null when there is none."""
    digits = F.regexp_extract(path, r"(?i)(?:MVI|IMG|VID)_(\d+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("double")


def identity_key(signer: Column, session: Column, source: Column, key: Column) -> Column:
    """Group that must stay on one side of a split: signer, else session, else the clip."""
    signer = F.trim(F.coalesce(signer, F.lit("")))
    session = F.trim(F.coalesce(session, F.lit("")))
    good_signer = (signer != "") & ~F.lower(signer).isin("nan", "none", "unknown")
    good_session = (session != "") & (F.lower(session) != "nan")
    return (
        F.when(good_signer, F.concat(F.lit("signer:"), signer))
        .when(good_session, F.concat(F.lit("session:"), session))
        .otherwise(F.concat(F.lit("clip:"), source, F.lit(":"), key))
    )


def fewshot_identity(signer: Column, video_path: Column, file_name_: Column) -> Column:
    """Few-shot identity: a signer that starts with User<digits>, else a session tag, else the clip."""
    signer = F.trim(F.coalesce(signer, F.lit("")))
    blob = F.concat_ws(" ", video_path, file_name_)
    tag = F.regexp_extract(blob, r"(?i)session(\d+)", 1)
    return (
        F.when(signer.rlike(r"(?i)^User\d+"), F.concat(F.lit("signer:"), signer))
        .when(tag != "", F.concat(F.lit("session:"), tag))
        .otherwise(F.concat(F.lit("clip:"), video_path))
    )


def clip_key(source: Column, rel: Column) -> Column:
    stem = F.regexp_replace(file_stem(rel), r"[^A-Za-z0-9]+", "_")
    stem = F.regexp_replace(F.substring(stem, 1, 40), r"^_+|_+$", "")
    digest = F.substring(F.sha1(F.concat(source, F.lit("/"), rel)), 1, 10)
    return F.concat_ws("_", source, stem, digest)


def portable_path(path: Column, root_prefix: str = fixed.CORPUS_FOLDER) -> Column:
    """Path from the last folder whose name starts with root_prefix, else folder/file."""
    parts = F.split(path, "/")
    marked = F.transform(
        parts, lambda p, i: F.when(F.upper(p).startswith(root_prefix), i + 1).otherwise(F.lit(0))
    )
    at = F.array_max(marked)
    tail = F.when(at > 0, F.slice(parts, at, F.size(parts))).otherwise(
        F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), F.lit(2))
    )
    return F.concat_ws("/", tail)


def cache_key(path: Column, frames: int, version: str = "v2") -> Column:
    """Content-addressed cache name. v2 hashes the portable path, v1 the whole path."""
    base = portable_path(path) if version == "v2" else path
    digest = F.substring(F.sha1(F.concat_ws("|", base, F.lit(str(frames)), F.lit(version))), 1, 16)
    return F.concat(file_stem(path), F.lit(f"__T{frames}__"), digest, F.lit(".npy"))


def label_from_path(path: Column, nfkc: bool = True) -> Column:
    """Nearest parent folder that is not generic and not a user folder, else the file name."""
    folders = F.filter(
        F.reverse(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)),
        lambda p: (p != "")
        & ~F.lower(p).isin(*fixed.GENERIC_FOLDERS)
        & ~F.lower(p).rlike(r"^(user\d+|isl_data_user\d+)$"),
    )
    stem = file_stem(path)
    cut = F.regexp_replace(F.regexp_replace(stem, r"(?i)_(session|clip|id).*$", ""), r"(_?\d+)+$", "")
    from_name = F.when(stem.contains("__"), F.element_at(F.split(stem, "__"), 1)).otherwise(
        F.element_at(F.split(cut, "_"), 1)
    )
    return normalize_label(F.coalesce(strip_index(F.get(folders, 0)), from_name), nfkc)


def dictionary_word(path: Column) -> Column:
    return normalize_gloss(F.regexp_replace(file_stem(path), r"(?i)\s*-\s*(English|Hindi|ISL)\s*$", ""))


def corpus_relative(path: Column) -> Column:
    """Forward slashes, everything up to the corpus folder removed."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), rf"^.*?{fixed.CORPUS_FOLDER}[^/]*/", "")


def canonical_model(name: Column) -> Column:
    n = F.replace(F.lower(F.trim(name)), F.lit("-"), F.lit("_"))
    return map_lookup(fixed.MODEL_ALIASES, n, n)


def run_name(tag: Column, model: Column, shots: Column, seed: Column) -> Column:
    k = F.concat(F.lit("K"), F.coalesce(shots.cast("string"), F.lit("all")))
    return F.concat_ws("/", tag, canonical_model(model), k, F.concat(F.lit("s"), seed.cast("string")))


def protocol_tag(
    protocol: Column, targets: Column, rich_shots: Column, n_words: Column,
    train_sources: Column, test_sources: Column,
) -> Column:
    """Variant name without shots and seed; absent parts are left out."""
    return F.concat_ws(
        "_",
        protocol,
        F.when(protocol == "scarce", targets),
        F.when(protocol == "scarce", F.concat(F.lit("rich"), rich_shots.cast("string"))),
        F.when(
            protocol == "cross_source",
            F.concat(F.array_join(train_sources, "-"), F.lit("_to_"), F.array_join(test_sources, "-")),
        ),
        F.when(n_words > 0, F.concat(F.lit("V"), n_words.cast("string"))),
    )


def output_name(word: Column, dataset: Column, position: Column, path: Column) -> Column:
    return F.format_string("%s__%s__%05d__%s.mp4", folder_name(word), dataset, position, file_stem(path))


def letter_counts(text: Column, alphabet: str) -> Column:
    """How often each of some ASCII characters occurs in a text, in one pass over its bytes; a null text has none."""
    codes = np.frombuffer(alphabet.encode("ascii"), np.uint8)

    @F.arrow_udf("array<double>")
    def counts(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_binary())
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
        found = [np.bincount(data[a:b], minlength=256)[codes] for a, b in zip(ends, ends[1:])]
        flat = np.concatenate(found).astype(np.float64) if found else np.zeros(0)
        return pa.ListArray.from_arrays(np.arange(len(texts) + 1, dtype=np.int32) * len(codes), pa.array(flat))

    return counts(text)

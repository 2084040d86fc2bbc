"""Line-first quality rules: judge each line, remove the lines that fail, reject documents that lose too much.

Words are ``[^\\x20\\x09-\\x0D]+``; lines are what ``\\n`` separates. A line fails as

* punctuation: at least ``MARKS`` of its non-blank characters are ASCII punctuation other than the marks of sentences
  (of four words or more),
* navigation: at least ``BARS`` of its words are separators such as ``|`` (of four words or more),
* boilerplate: a line of at most ``FURNITURE_WORDS`` words with a phrase of page furniture in English, French, German or
  Spanish (``FURNITURE``); prose that mentions such a phrase is longer.

A document fails the base rules with under 10 words, or with over 20 % of its words in 5-word windows that occur
twice or more in it. It is kept if it passes these and loses at most ``max_lost`` of its non-blank characters.
Null text counts as empty and fails the base rules. Texts of any length are read whole. Every row gives one row,
repeated or not; an empty table gives an empty result; other columns pass through ``clean_documents`` unchanged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import RID, pick, raw_bytes, slices, small_batches, split_words, strings

MARKS, BARS, MAX_LOST = 0.20, 0.20, 0.30
SYMBOLS = b"#*$%&|<>"
SENTENCE = b".,;:!?'\"()-"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in SENTENCE)
SEPARATORS = ["|", "||", "»", "›", "«", "·", "•", ">", ">>", "::", "/"]
FURNITURE_WORDS = 10
PHRASES = {
    "en": (
        "all rights reserved", "terms (?:of|and) (?:use|service|conditions)", "privacy policy", "cookie (?:policy|settings)", "(?:we|this site|this website) uses? cookies",
        "accept (?:all )?cookies", "enable javascript", "javascript (?:is|must be) (?:disabled|enabled)", "lorem ipsum", "click here", "read more", "sign up (?:for|now)",
        "subscribe (?:to|now)", "log ?in to", "skip to (?:main )?content", "back to top", "share (?:this|on) (?:post|page|facebook|twitter)", "page [0-9]+ of [0-9]+", "site ?map", "follow us on",
    ),
    "fr": (
        "tous droits r.serv.s", "mentions l.gales", "conditions (?:g.n.rales )?d.utilisation", "politique de confidentialit.", "accepter (?:tous )?les cookies", "ce site utilise des cookies",
        "cliquez ici", "lire la suite", "en savoir plus", "inscrivez-vous", "se connecter", "retour en haut", "aller au contenu", "plan du site", "suivez-nous sur", "partager sur (?:facebook|twitter)",
    ),
    "de": (
        "alle rechte vorbehalten", "allgemeine gesch.ftsbedingungen", "datenschutzerkl.rung", "nutzungsbedingungen", "cookies (?:akzeptieren|zulassen)", "diese (?:seite|website) verwendet cookies",
        "hier klicken", "mehr (?:lesen|erfahren)", "jetzt (?:anmelden|registrieren|abonnieren)", "nach oben", "zum inhalt springen", "seite [0-9]+ von [0-9]+", "folgen sie uns", "javascript aktivieren",
    ),
    "es": (
        "todos los derechos reservados", "aviso legal", "t.rminos (?:de uso|y condiciones)", "pol.tica de (?:privacidad|cookies)", "aceptar (?:todas )?las cookies", "este sitio (?:web )?utiliza cookies",
        "haga clic aqu.", "leer m.s", "iniciar sesi.n", "reg.strate", "volver arriba", "saltar al contenido", "mapa del sitio", "s.guenos en", "compartir en (?:facebook|twitter)", "p.gina [0-9]+ de [0-9]+",
    ),
}
FURNITURE = r"(?i)(?:^|[^\p{L}\p{N}])(?:" + "|".join(p for ps in PHRASES.values() for p in ps) + r")(?:$|[^\p{L}\p{N}])"


def _table(marks: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(marks)] = True
    return lut


_SYMBOL, _PUNCT, _BLANK = _table(SYMBOLS), _table(PUNCTUATION), _table(b" \t\n\x0b\x0c\r")


def _per_item(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many of the hit positions lie in each item."""
    return np.diff(np.searchsorted(np.flatnonzero(hit), offsets))


def repeated_window_words(codes: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> np.ndarray:
    """Words of each document that lie in ``width``-word windows found twice or more in it; exact, by ranking."""
    n = len(codes)
    if n < width:
        return np.zeros(n_docs, np.int64)
    rank = lambda left, right, m: pd.factorize(left[:m].astype(np.int64) * (int(right.max()) + 1) + right[:m])[0]
    two = rank(codes, codes[1:], n - 1)
    four = rank(two, two[2:], n - 3)
    five = rank(four, codes[4:], n - 4)
    inside = doc[: n - 4] == doc[4:]
    at = np.flatnonzero(inside)
    own = pd.factorize(five[at].astype(np.int64) * n_docs + doc[at])[0]
    at = at[np.bincount(own)[own] > 1]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.bincount(doc, np.cumsum(step)[:n] > 0, n_docs).astype(np.int64)


def failing_lines(lines: pa.Array, owner: np.ndarray, words: pa.Array, codes: np.ndarray, vocabulary: pa.Array) -> np.ndarray:
    """Which lines fail a rule; ``owner`` is the line of each word."""
    data, offsets = raw_bytes(lines)
    n_words = np.bincount(owner, minlength=len(lines))
    # A byte that begins a character counts as the character.
    solid = _per_item(~_BLANK[data] & ((data & 0xC0) != 0x80), offsets)
    marks = _per_item(_PUNCT[data], offsets)
    bar = pc.is_in(vocabulary, pa.array(SEPARATORS, vocabulary.type)).to_numpy(zero_copy_only=False)
    bars = np.bincount(owner, bar[codes], len(lines)) if len(codes) else np.zeros(len(lines))
    enough = n_words >= 4
    furniture = np.zeros(len(lines), bool)
    short = np.flatnonzero((n_words > 0) & (n_words <= FURNITURE_WORDS))
    furniture[short] = pc.match_substring_regex(lines.take(pa.array(short)), FURNITURE).to_numpy(zero_copy_only=False)
    return (enough & (marks >= MARKS * np.maximum(solid, 1))) | (enough & (bars >= BARS * n_words)) | furniture


def measure(texts: pa.Array) -> dict[str, object]:
    """All measures of the texts, and the texts without their failing lines."""
    n = len(texts)
    parts = pc.split_pattern(texts, "\n")
    lines, line_doc = parts.flatten(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, words = split_words(lines)
    coded = words.dictionary_encode()
    codes, vocabulary = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
    doc = line_doc[owner] if len(owner) else np.zeros(0, np.int64)
    n_words = np.bincount(doc, minlength=n)
    lengths = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
    data, offsets = raw_bytes(texts)

    has_word = np.bincount(owner, minlength=len(lines)) > 0
    at = np.flatnonzero(has_word)
    line_codes = lines.take(pa.array(at)).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    again = pd.Series(line_codes * n + line_doc[at]).duplicated().to_numpy()

    fails = failing_lines(lines, owner, words, codes, vocabulary)
    data_l, offsets_l = raw_bytes(lines)
    solid = _per_item(~_BLANK[data_l] & ((data_l & 0xC0) != 0x80), offsets_l)
    removed = np.bincount(line_doc, solid * fails, n)
    total = np.bincount(line_doc, solid, n)
    repeats = repeated_window_words(codes, doc, n)
    base_failed = (n_words < 10) | (100 * repeats > 20 * n_words)

    clean = texts
    if fails.any():
        good = ~fails
        ends = np.concatenate([[0], np.cumsum(np.bincount(line_doc[good], minlength=n))])
        clean = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lines.filter(pa.array(good))), "\n")
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": np.bincount(doc, lengths[codes] if len(codes) else None, n).astype(np.int64),
        "n_symbols": _per_item(_SYMBOL[data], offsets).astype(np.int64),
        "n_dup_lines": np.bincount(line_doc[at], again, n).astype(np.int64),
        "n_repeat_words": repeats,
        "base_failed": base_failed,
        "n_lines_removed": np.bincount(line_doc, fails, n).astype(np.int64),
        "lost": removed / np.maximum(total, 1),
        "clean_text": clean,
    }


FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lines_removed long, lost double, clean_text string"


def _judge(keep: list[str], max_lost: float):
    def run(batches):
        for b in slices(batches, "text"):
            m = measure(strings(b, "text").cast(pa.string()))
            own = [b.column(b.schema.get_field_index(c)) for c in keep]
            kept = ~m["base_failed"] & (m["lost"] <= max_lost)
            yield pa.RecordBatch.from_arrays([*own, *(x if isinstance(x, pa.Array) else pa.array(x) for x in m.values()), pa.array(kept)], names=[*keep, *m, "kept"])

    return run


def judge_documents(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """rid, doc_id, the measures, the cleaned text and the verdict, for each document."""
    small_batches(docs.sparkSession)
    base = pick(docs, "doc_id", "text", rid=True).select(F.col(RID).alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return base.mapInArrow(_judge(["rid", "doc_id"], max_lost), f"rid {base.schema['rid'].dataType.simpleString()}, doc_id long, {FIELDS}, kept boolean")


def clean_documents(docs: DataFrame, max_lost: float = MAX_LOST) -> DataFrame:
    """The kept documents with their cleaned text (n_chars follows it); the columns of ``docs`` as they were."""
    small_batches(docs.sparkSession)
    text = docs.columns.index("text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    bare = docs.toDF(*["text" if i == text else n for i, n in enumerate(names)])
    keep = [c for c in bare.columns if c != "text"]
    types = ", ".join(f"{c} {bare.schema[c].dataType.simpleString()}" for c in keep)
    judged = bare.mapInArrow(_judge(keep, max_lost), f"{types}, {FIELDS}, kept boolean").where("kept")
    source = {"text": "clean_text"}
    cols = [F.col(source.get(c, names[i])).alias(c) if c != "n_chars" else F.length("clean_text").cast(docs.schema[i].dataType).alias(c) for i, c in enumerate(docs.columns)]
    return judged.select(*cols)

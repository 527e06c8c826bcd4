"""Quality rules, line first: rules remove lines, then documents that lose too much text are rejected.

Every line with a word is put to the punctuation, navigation and boilerplate rules; failing lines are removed, and
``cleaned`` is the text of the lines that stay, as they are and in their order. A document is kept if it passes the base rules and keeps at least ``MIN_KEPT_SHARE`` of its words.
Base statistics are those of the query contract. One task reads one text at a time; nothing is shuffled.

Defined results: a null or empty text has no words and fails the base rules; lines without a word are
neither counted nor lost (they stay in the text); the cleaned text of a null is null; repeated rows are judged alike; an empty table gives an empty result; other columns
are carried.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplymetrics.llm.common import ship

ship(__name__)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_KEPT_SHARE = 0.5
SYMBOLS = re.compile(r"[#*$%&|<>]")
# Line rules. A line fails if it
SENTENCE_END = r"[.!?…:;。！？][\"'”’»)\]]*(\s|$)"  # has no end of a sentence or list head in it (punctuation)
NAVIGATION = r"[|»›•·].*[|»›•·]"  # has two or more menu separators (navigation)
# has a phrase of legal or site boilerplate, in lower case, by language (boilerplate)
PHRASES = {
    "en": (r"all rights reserved", r"copyright", r"\(c\) [0-9]{4}", r"licensed under", r"terms of (use|service)", r"privacy policy", r"cookie policy",
           r"accept cookies", r"sign up", r"log ?in", r"subscribe now", r"click here", r"lorem ipsum"),
    "de": (r"alle rechte vorbehalten", r"nutzungsbedingungen", r"allgemeine geschäftsbedingungen", r"datenschutzerklärung", r"cookies akzeptieren",
           r"jetzt anmelden", r"jetzt abonnieren", r"hier klicken"),
    "fr": (r"tous droits réservés", r"conditions (générales )?d['’]utilisation", r"politique de confidentialité", r"accepter les cookies",
           r"abonnez-vous", r"cliquez ici", r"mentions légales"),
    "es": (r"todos los derechos reservados", r"condiciones de uso", r"términos y condiciones", r"política de privacidad", r"aceptar (las )?cookies",
           r"suscríbete", r"haga clic aquí", r"aviso legal"),
}
BOILERPLATE = "(" + "|".join(p for phrases in PHRASES.values() for p in phrases) + ")"
NOISY_WORD = r"[#*$%&<>!]{2}$"  # has most of its words end in symbol runs (punctuation)
SENTENCE_RE, NAVIGATION_RE, BOILERPLATE_RE, NOISY_RE = (re.compile(p) for p in (SENTENCE_END, NAVIGATION, BOILERPLATE, NOISY_WORD))

STATS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
         "n_lines long, n_lines_lost long, kept_words long, cleaned string")


def line_fails(line: str, words: list[str]) -> bool:
    return (2 * sum(1 for w in words if NOISY_RE.search(w)) > len(words)
            or not SENTENCE_RE.search(line)
            or NAVIGATION_RE.search(line) is not None
            or BOILERPLATE_RE.search(line.lower()) is not None)


def ascii_words(text: str) -> list[str]:
    """Runs of characters other than the six white space characters."""
    return [w.decode("utf-8", "replace") for w in text.encode("utf-8", "replace").split()]


def repeated_words(words: list[str]) -> int:
    """Words inside a 3-word window that occurs twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    n = last = 0  # words before ``last`` are counted
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(i, last)
            last = i + 3
    return n


def stats_of(text: str | None) -> tuple:
    """The fields of ``STATS`` of one text."""
    absent, text = text is None, text or ""
    words = ascii_words(text)
    seen, duplicates, lines, lost, kept, stay = set(), 0, 0, 0, 0, []
    for line in text.split("\n"):
        own = ascii_words(line)
        if own:
            lines += 1
            duplicates += line in seen
            seen.add(line)
            if line_fails(line, own):
                lost += 1
                continue
            kept += len(own)
        stay.append(line)
    return (len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), duplicates, repeated_words(words), lines, lost, kept,
            None if absent else "\n".join(stay))


def stats(text: Column) -> Column:
    names = [f.split()[0] for f in STATS.split(", ")]

    @F.pandas_udf(STATS)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([stats_of(t) for t in texts], columns=names)

    return run(text)


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: doc (the whole row as struct), the statistics, the cleaned text, base_failed and kept."""
    s = docs.select(F.struct("*").alias("doc"), stats(F.col("text")).alias("s")).select("doc", "s.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return s.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (F.col("kept_words") >= MIN_KEPT_SHARE * F.col("n_words")))


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the cleaned text in place of the text. The columns are the input's."""
    kept = judge(docs).filter("kept")
    return kept.select(*[F.col("cleaned").alias(c) if c == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])

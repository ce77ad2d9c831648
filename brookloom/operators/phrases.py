"""Noun phrases and people: a small tagger of word classes, and a chunker over its classes.

Each word has a score for each class: closed classes come from lists, open ones from the word's ending, and what is unknown
is most likely a noun. The classes of a sentence are those of the best path by the scores of words and of neighbouring
classes (Viterbi). All sentences of a batch of texts go through it side by side, a word of each at a time, so the work is
linear in the words, and arrays of small numbers do it. A noun phrase is a run of adjectives and nouns that ends with a
noun. The tagger knows English; words of other languages are nouns to it, but for the endings that they share.

Phrases count by their small form. A single noun must stand SINGLE_LEAST times and be no common noun; several words twice, or
once with an anchor among them, and not all may be common nouns. A phrase ends at verbs that look like plural nouns.

Defined results: null and empty texts hold no phrase and no person; repeated rows are texts of their own; equal counts go
by name; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookloom.functions.text import blanked_code
from brookloom.operators.terms import ANCHOR_LEAST, ANCHORS, BREAKERS, COMMON_NOUNS, PHRASE_LEAST, SINGLE_LEAST, STOP_WORDS

#: Word classes: noun, verb, adjective, adverb, determiner, preposition, pronoun, conjunction, auxiliary.
NOUN, VERB, ADJ, ADV, DET, PREP, PRON, CONJ, AUX = range(9)
CLOSED = {
    DET: "a an the this that these those each every some any no all both either neither another such its their our your my his her",
    PREP: "of in on at by for with from into onto over under about after before between through during without within against among across behind beyond near since than toward towards upon via per as like to",
    PRON: "i you he she it we they me him us them who whom which what whose itself themselves himself herself one there",
    CONJ: "and or but nor so yet because although though while if unless until when where whether how why",
    AUX: "is are was were be been being am has have had do does did will would shall should can could may might must not",
    ADV: "very too also just only even still already often never always now then here again soon more most less least well almost quite rather up down out off away back",
    ADJ: "new old good bad big small large high low long short great own same other different early late many few much several first last next main free full real open hard easy fast slow",
    VERB: "be go get make take see come know think say use find give tell work call try ask need feel become leave put mean keep let begin seem help show hear play run move live believe hold bring happen write provide sit stand lose pay meet include continue set learn change lead understand watch follow stop create speak read allow add spend grow open walk win offer remember love consider appear buy wait serve die send expect build stay fall cut reach kill remain made went took came saw knew thought said used found gave told",
}
#: (ending, class, score): what a word's ending says beside that a word is a noun.
ENDINGS = (
    ("tion", NOUN, 3.0), ("sion", NOUN, 3.0), ("ment", NOUN, 2.5), ("ness", NOUN, 3.0), ("ity", NOUN, 3.0), ("ship", NOUN, 2.5), ("ism", NOUN, 2.5), ("ance", NOUN, 2.0), ("ence", NOUN, 2.0),
    ("er", NOUN, 0.5), ("or", NOUN, 0.5), ("able", ADJ, 3.0), ("ible", ADJ, 3.0), ("ful", ADJ, 3.0), ("ous", ADJ, 3.0), ("less", ADJ, 2.5), ("ive", ADJ, 2.0), ("ical", ADJ, 3.0), ("al", ADJ, 1.5),
    ("ic", ADJ, 1.5), ("ary", ADJ, 1.0), ("ly", ADV, 4.0), ("ize", VERB, 3.0), ("ise", VERB, 1.5), ("ify", VERB, 3.0), ("ed", VERB, 2.5), ("ing", VERB, 1.6), ("izes", VERB, 3.0), ("ifies", VERB, 3.0),
)
#: Scores of a class (column) after another (row), in the order of the classes; all others are 0.
FOLLOWS = {
    DET: {NOUN: 2.0, ADJ: 2.0, ADV: 0.0, VERB: -3.0, DET: -3.0, PREP: -2.0, PRON: -2.0, CONJ: -3.0, AUX: -3.0},
    ADJ: {NOUN: 2.5, ADJ: 0.8, VERB: -1.5, PRON: -1.5, AUX: -0.5, DET: -1.5},
    NOUN: {NOUN: 0.6, VERB: 0.7, AUX: 1.0, PREP: 1.0, CONJ: 0.7, PRON: -0.7, DET: -1.0, ADJ: -1.0},
    VERB: {DET: 1.2, NOUN: 0.4, ADJ: 0.4, ADV: 0.6, PREP: 0.8, PRON: 0.6, VERB: -1.5, AUX: -1.5},
    ADV: {VERB: 1.0, ADJ: 0.8, ADV: 0.2, NOUN: -0.6},
    PREP: {NOUN: 1.2, DET: 1.5, ADJ: 0.8, PRON: 0.5, VERB: -1.0, AUX: -2.0, PREP: -1.0, CONJ: -2.0},
    PRON: {VERB: 1.5, AUX: 1.5, ADV: 0.3, NOUN: -1.0, ADJ: -0.8, DET: -1.0},
    CONJ: {NOUN: 0.5, DET: 0.6, PRON: 0.6, ADJ: 0.4, VERB: 0.2, CONJ: -2.0},
    AUX: {VERB: 1.5, ADV: 0.8, ADJ: 0.8, DET: 0.6, PREP: 0.3, AUX: 0.4, NOUN: -0.4, PRON: 0.2},
}
CLASSES = 9
TRANSITION = np.array([[FOLLOWS[a].get(b, 0.0) for b in range(CLASSES)] for a in range(CLASSES)])
_CLOSED = {w: [c for c, words in CLOSED.items() if w in words.split()] for w in set(" ".join(CLOSED.values()).split())}
_SENTENCE, _WORD = re.compile(r"[.!?;:\n]+"), re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[,()\[\]\"“”]|\d\S*")
#: Titles before a person's name.
TITLES = "Mr Mrs Ms Dr Prof Professor President Senator Judge Captain Sir Lady".split()
_PERSON = re.compile(rf"(?<![A-Za-z])(?:{'|'.join(TITLES)})\.? ((?:[A-Z][a-z]+|[A-Z]\.)(?:[ -][A-Z][a-z]+)*)|(?<![A-Za-z])([A-Z][a-z]+(?: [A-Z]\.)?(?: [A-Z][a-z]+)) (?:said|says|told|writes|wrote|argued|argues|added|explained|noted)\b")


#: Most words of a sentence, and sentences that are tagged at a time: what a task holds beside its texts.
MOST_WORDS, SIDE_BY_SIDE = 64, 2048
#: Characters of texts that are split and tagged at a time.
SLICE_CHARS = 1_000_000


@lru_cache(maxsize=50_000)
def scores(word: str) -> tuple[float, ...]:
    """A word's score in each class."""
    low, out = word.lower(), [-6.0] * CLASSES
    if low in _CLOSED:
        for c in _CLOSED[low]:
            out[c] = 4.0
        if VERB in _CLOSED[low]:
            out[NOUN] = 2.2
        return tuple(out)
    out[NOUN], out[VERB], out[ADJ], out[ADV] = 2.0, 0.2, 0.4, -2.0
    for ending, c, s in ENDINGS:
        if low.endswith(ending) and len(low) > len(ending) + 2:
            out[c] += s
    if low.endswith("s") and not low.endswith("ss"):
        out[VERB] += 0.6
        out[ADJ] -= 1.5
    if word[:1].isupper():
        out[NOUN] += 1.0
    return tuple(out)


def tagged(sentences: list[list[str]]) -> list[np.ndarray]:
    """The classes of the best path through each sentence; those of about one length go side by side."""
    order = sorted(range(len(sentences)), key=lambda i: -len(sentences[i]))
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(sentences)
    for lo in range(0, len(order), SIDE_BY_SIDE):
        _tag(sentences, order[lo : lo + SIDE_BY_SIDE], out)
    return out


def _tag(sentences: list[list[str]], order: list[int], out: list[np.ndarray]) -> None:
    size = np.array([len(sentences[i]) for i in order])
    longest = int(size.max(initial=0))
    own = np.zeros((len(order), longest, CLASSES))
    for row, i in enumerate(order):
        if sentences[i]:
            own[row, : size[row]] = [scores(w) for w in sentences[i]]
    back = np.zeros((len(order), longest, CLASSES), np.int8)
    best = own[:, 0] if longest else own.reshape(len(order), 0)
    last = best.copy()
    for t in range(1, longest):
        n = int(np.searchsorted(-size, -t, side="left"))  # those longer than t come first
        paths = best[:n, :, None] + TRANSITION
        back[:n, t] = paths.argmax(1)
        best = paths.max(1) + own[:n, t]
        last[:n] = best
    at = last.argmax(1) if longest else np.empty(0, int)
    path = np.zeros((len(order), longest), np.int8)
    for t in range(longest - 1, -1, -1):
        live = size > t
        path[live, t] = at[live]
        at = np.where(live, back[np.arange(len(order)), t, at], at)
    for row, i in enumerate(order):
        out[i] = path[row, : size[row]].copy()


def split(text: str) -> list[list[str]]:
    """The sentences of a text as words; marks inside a sentence end one too, and so do MOST_WORDS words."""
    out = []
    for s in _SENTENCE.split(text):
        words: list[str] = []
        for w in _WORD.findall(s):
            if w[0].isalpha():
                words.append(w)
            if words and (len(words) == MOST_WORDS or not w[0].isalpha()):
                out.append(words)
                words = []
        if words:
            out.append(words)
    return out


def chunks(words: list[str], classes: np.ndarray, longest: int = 4) -> list[list[str]]:
    """The noun phrases of a sentence: runs of adjectives and nouns up to their last noun, cut at breakers; of longer ones the
    last words, where the head stands."""
    out, run = [], []
    for w, c in [*zip(words, classes.tolist(), strict=True), ("", PREP)]:
        if c in (NOUN, ADJ) and w.lower() not in BREAKERS:
            run.append((w, c))
            continue
        while run and run[-1][1] != NOUN:
            run.pop()
        if run:
            out.append([x for x, _ in run[-longest:]])
        run = []
    return out


def substantive(words: list[str]) -> bool:
    """Whether any word is no stop word."""
    return any(w.lower() not in _STOP for w in words)


_STOP, _COMMON, _ANCHORS = frozenset(STOP_WORDS), frozenset(COMMON_NOUNS), frozenset(ANCHORS)


def frequent(phrases: list[list[str]]) -> list[tuple[str, int]]:
    """(phrase in small letters, times) of those frequent enough, the most frequent first. A phrase counts, and so does its
    head of two words and of one where it is longer."""
    n: Counter[str] = Counter()
    for p in phrases:
        low = [w.lower() for w in p]
        n.update({" ".join(low[-k:]) for k in range(1, len(low) + 1)})
    out = []
    for term, times in n.items():
        own = term.split(" ")
        common = all(w in _COMMON for w in own)
        if not substantive(own) or common or len(term) > 60:
            continue
        if len(own) == 1:
            ok = times >= SINGLE_LEAST and len(term) >= 5
        else:
            ok = times >= (ANCHOR_LEAST if any(w in _ANCHORS or w.removesuffix("s") in _ANCHORS for w in own) else PHRASE_LEAST)
        if ok:
            out.append((term, times))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def people_in(text: str) -> list[str]:
    """Names of people: behind a title, or two words before a verb of saying; each once, in order."""
    return list(dict.fromkeys(a or b for a, b in _PERSON.findall(text)))


def sliced(batch: pa.RecordBatch, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """A batch's rows in order, in slices of up to ``most`` bytes of ``text``, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
    lo = held = 0
    for i, n in enumerate(sizes):
        if i > lo and held + n > most:
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += n
    if sizes:
        yield batch.slice(lo)


def _mapped(docs: DataFrame, texts, work, item: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = {"struct<term:string,n:int>": pa.list_(pa.struct([("term", pa.string()), ("n", pa.int32())])), "string": pa.list_(pa.string())}[item]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                rows = work([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(rows, arrow)], names=["doc_id", "found"])

    return docs.select("doc_id", texts.alias("text")).mapInArrow(run, f"doc_id {kind}, found array<{item}>")


def phrases_of(texts: list[str]) -> list[list[tuple[str, int]]]:
    """The frequent noun phrases of each text; SLICE_CHARS of them are held as words at a time."""
    out: list[list[tuple[str, int]]] = []
    sentences: list[list[list[str]]] = []
    size = 0

    def flush() -> None:
        classes = iter(tagged([s for of in sentences for s in of]))
        out.extend(frequent([p for s in of for p in chunks(s, next(classes))]) for of in sentences)

    for t in texts:
        if sentences and size + len(t) > SLICE_CHARS:
            flush()
            sentences, size = [], 0
        sentences.append(split(t))
        size += len(t)
    flush()
    return out


def noun_phrases(docs: DataFrame) -> DataFrame:
    """doc_id, term and n of the frequent noun phrases of each text, code and addresses blanked."""
    found = _mapped(docs, blanked_code(F.col("text")), lambda texts: [[{"term": t, "n": n} for t, n in found] for found in phrases_of(texts)], "struct<term:string,n:int>")
    return found.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.term", "f.n")


def people(docs: DataFrame) -> DataFrame:
    """doc_id and each name of a person in its text."""
    found = _mapped(docs, F.col("text").cast("string"), lambda texts: [people_in(t) for t in texts], "string")
    return found.select("doc_id", F.explode("found").alias("name"))

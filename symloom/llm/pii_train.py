"""Labelled spans for the PII tagger, and its training.

    python -m symloom.llm.pii_train OUT.npz [--start OLD.npz] DOCUMENTS.parquet [DOCUMENTS.parquet ...]

The labels are made in two steps. Names are induced from a sample of documents: whoever is greeted, signs,
is thanked or stands in a record in a place where only people stand gives first names and surnames, which
are then labelled wherever they stand as a full name or with a title. The other kinds are labelled by
their published formats and the words before them. Then the values are varied (other syllables, other
digits), so that the tagger learns forms and surroundings rather than the sample's names. Sentences written by hand
(pii_frames.py) are added, with names in other cases and scripts, so that it knows other surroundings than the sample's.
The windows are those of whole texts; each pass takes other ones without spans, so that all of them are seen.
"""

from __future__ import annotations

import random
import re
import sys
import time
from collections import Counter
from multiprocessing import Pool

import numpy as np

from symloom.llm.pii import WINDOW, cut, stretches
from symloom.llm.pii_frames import composed
from symloom.llm.tagger import KINDS, PAD, Adam, Tagger, encode

#: Documents that labels are taken from, windows of a pass (bounded; a third of them with spans), units in a direction, passes, windows in a step.
DOCUMENTS, WINDOWS, HIDDEN, PASSES, STEP_SIZE = 100_000, 144_000, 48, 11, 160
#: Passes from weights that are given, and the size of their steps; processes that share a step.
MORE_PASSES, MORE_SCALE, WORKERS = 3, 0.3, 8
#: Texts made of the sentences written by hand, and copies with other values of each text that has spans.
COMPOSED, COPIES = 14000, 5

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_WORD = rf"[{_UP}][{_LOW}’']+(?:-[{_UP}][{_LOW}]+)?"
_PEOPLE = re.compile(
    rf"(?:\bHi|\bDear|\bRegards,|\bThanks,|\b(?:Mr|Mrs|Ms|Dr)\.?|\bMme|\bFrau|\bHerr|Signed-off-by:|Reviewed-by:|Author:|Owner:|According to|Interview with|went to|Reviewed by|\"(?:customer|name|contact)\": \"|user=)[ ]?"
    rf"(?P<first>{_WORD})[ _](?:[A-Z]\.[ _])?(?P<last>{_WORD})"
)

_EMAIL = re.compile(r"(?<![\w.+@/-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}(?!\w)|(?<![\w.+-])[\w.+%-]+ ?(?:\[at\]|\(at\)) ?[\w-]+(?:(?:\.| ?(?:\[dot\]|\(dot\)) ?)[\w-]+)+|(?<![\w.+-])[\w.+%-]*[\d._][\w.+%-]* at [\w-]+\.[a-z]{2,}(?:\.[a-z]{2,})?(?!\w)|(?<![\w.+-])[\w.+%-]+ at [\w-]+ dot [a-z]{2,}(?!\w)")
_PHONE = re.compile(
    r"(?<![\w.+/-])(?:\+\d{1,3} ?\(\d{3}\) ?\d{3}[ -]\d{4}|\+\d{2} \d(?: \d\d){4}|\+\d{2} \d{4} \d{6}|\+\d{2} \d{2,4} \d{4,6}(?: \d{3})?|\+\d{9,14}|00\d{10,13}|\(\d{3}\) \d{3}[ -]\d{4}|\d{3}([-.])\d{3}\1\d{4}|\d{3} \d{3} \d{4}|0\d{4} \d{3} \d{3}|0\d{2,4}/\d{4,6}(?:-\d{2,4})?|0\d{9,10})(?![\w/-]|\.\d)"
)
_ID_LEAD = r"(?:SSN|social security (?:number|no\.?)|national insurance(?: (?:number|no\.?))?|national ID|national|personal tax (?:number|no\.?)|personal|passport(?: (?:number|no\.?))?|Ausweisnummer|Personalausweis|driver's(?: licence| license)?|tax ID|identity(?: (?:card|number|no\.?))*)"
_ID = re.compile(_ID_LEAD + r"(?: is)?[ :=]{1,3}(?P<value>[A-Z]{0,3} ?\d[\dA-Z -]*[\dA-Z])(?=[\s).,;]|$)")
_ROAD = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Blvd|Boulevard|Avenue|Ave\.?|Close|Court|Ct\.?|Drive|Dr\.?|Way|Terrace|Row|Square)"
_TOWN = rf"[{_UP}][{_LOW}]+(?: [{_UP}][{_LOW}]+)?"
_UNIT = r"(?:, (?:Flat|Apt\.?|Unit|Suite) \d+[A-Z]?)?"
_SEP = r"(?:,? |\r?\n|,\r?\n)"
_ADDRESS = re.compile(
    rf"(?:\d{{1,4}} (?:[{_UP}][{_LOW}]+ ){{1,2}}{_ROAD}{_UNIT}(?:{_SEP}{_TOWN}(?:,? \d{{4,5}})?)?"
    rf"|{_TOWN}, \d{{1,4}} (?:[{_UP}][{_LOW}]+ ){{1,2}}{_ROAD}{_UNIT}"
    rf"|\d{{1,4}},? (?:bis )?(?:rue|avenue|place|chemin) (?:d[eu]s? |de la )?[{_UP}]?[{_LOW}]+(?: [{_UP}][{_LOW}]+)?(?:{_SEP}\d{{5}} {_TOWN})?"
    rf"|(?:Calle|Avenida|Plaza) (?:de la |del? )?[{_UP}][{_LOW}]+ \d{{1,4}}(?:{_SEP}\d{{5}} {_TOWN})?"
    rf"|(?:(?:Am|An der|Zum|Zur|Im) [{_UP}][{_LOW}]+(?: [{_UP}][{_LOW}]+)?|[{_UP}][{_LOW}]+(?:straße|strasse|weg|gasse|platz|allee)) \d{{1,4}}(?:{_SEP}\d{{5}} {_TOWN})?"
    rf"|P\. ?O\. ?Box \d+(?:{_SEP}{_TOWN}(?:,? \d{{4,5}})?)?|Postfach \d+(?:{_SEP}\d{{5}} {_TOWN})?)"
)
# What follows an address on its line is another sentence: a word that begins one is no town.
_NO_TOWN = re.compile(rf"[,. \n]+(?:The|A|An|In|As|Each|Every|One|Our|Once|Most|Der|Die|Das|Ein|Eine|Bei|Wenn|Seit|Two|Below|With|Whoever|Requests|Contrary|If|El|La|Los|Si|Le|Les|Il|Un|Une|On|Open|Nobody|Pin|By|Under|During|See|For|Limits|Order|Build|Ticket|Set|Tel|Contact|cc|Approved|Thanks|Merci)(?: [{_UP}][{_LOW}]+)?$")


class Names:
    """First names and surnames induced from texts."""

    def __init__(self, texts: list[str], least: int = 3):
        first, last = Counter(), Counter()
        for text in texts:
            for m in _PEOPLE.finditer(text):
                first[m["first"]] += 1
                last.update(m["last"].split("-"))
        # Whoever is named with a title first ('Ms Wanda') is a first name in the place of a last one.
        self.first = {n for n, k in first.items() if k >= least and len(n) > 2 and n not in ("Mme", "Frau")}
        self.last = {n for n, k in last.items() if k >= least and n not in self.first and len(n) > 3}
        self.last |= self._beside(texts)
        f, s = ("|".join(sorted(map(re.escape, x), key=len, reverse=True)) or "(?!)" for x in (self.first, self.last))
        upper = "|".join(sorted((re.escape(n.upper()) for n in self.last), key=len, reverse=True)) or "(?!)"
        double = rf"(?:{s})(?:-(?:{s}))?"
        title = r"(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Frau|Herrn?|Mme|Mlle|M|Sr|Sra|Señora?)\.? )"
        self.pattern = re.compile(
            rf"(?<![\w@.+-])(?:(?P<full>(?:{f})[ _](?:[A-Z]\.[ _])?{double})|(?P<turned>(?:{double}|(?:{upper})(?:-(?:{upper}))?), (?:{f})(?: [A-Z]\.)?)|{title}(?P<titled>(?:[A-Z]\. )?{double})|(?P<initial>[A-Z]\. {double})|(?P<caps>(?:{'|'.join(re.escape(n.upper()) for n in self.first) or '(?!)'}) (?:{upper})))(?![\w@])"
        )

    def _beside(self, texts: list[str]) -> set[str]:
        """Words that stand beside a first name more often than not. One that does so often, but always with the
        same first name, is a part of a product's name."""
        f = "|".join(sorted(map(re.escape, self.first), key=len, reverse=True)) or "(?!)"
        near = re.compile(rf"(?<![\w@.+-])(?:(?P<first>{f})[ _](?:[A-Z]\.[ _])?(?P<last>{_WORD})|(?P<turned>(?!(?:Regards|Thanks|Dear|Hi|Merci|Danke|Gruß|Grüße|Gracias)\b){_WORD}), (?P<then>{f})\b(?! ?[{_UP}][{_LOW}]))")
        every, beside, firsts = Counter(), Counter(), {}
        for text in texts:
            every.update(re.findall(rf"\b[{_UP}][{_LOW}’']+", text))
            for m in near.finditer(text):
                for word in (m["last"] or m["turned"]).split("-"):
                    beside[word] += 1
                    firsts.setdefault(word, set()).add(m["first"] or m["then"])
        return {w for w, k in beside.items() if 2 * k >= every[w] and (k <= 3 or len(firsts[w]) > 1) and w not in self.first and len(w) > 3}

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        out = []
        for m in self.pattern.finditer(text):
            a, b = m.span(m.lastgroup)
            out.append((a, b, "person"))
        return out


def label(text: str, names: Names) -> list[tuple[int, int, str]]:
    """Labelled spans of a text, none overlapping; e-mail addresses first, then ids, phones, addresses, names."""
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> None:
        if b > a and not any(a < y and x < b for x, y, _ in found):
            found.append((a, b, kind))

    for m in _EMAIL.finditer(text):
        if not m[0].lower().startswith("git@") and not re.search(r"@v?\d", m[0]) and not re.search(r"//\S*:$", text[max(0, m.start() - 40) : m.start()]):
            add(m.start(), m.end(), "email")
    for m in _ID.finditer(text):
        if sum(c.isdigit() for c in m["value"]) >= 5:
            add(m.start("value"), m.end("value"), "id_number")
    for m in _PHONE.finditer(text):
        add(m.start(), m.end(), "phone")
    for m in _ADDRESS.finditer(text):
        value = _NO_TOWN.sub("", m[0])
        add(m.start(), m.start() + len(value), "address")
    for span in names.spans(text):
        add(*span)
    return sorted(found)


_ONSETS = "b br c ch d dr f fl g gr h j k kr l m n p pr r s sch st t th tr v w z".split()
_VOWELS = "a e i o u ai ei ou".split()
_CODAS = "n r s l m nd rt ck tt ll rs lk ft ng".split()


def _coined(rng: random.Random, syllables: int) -> str:
    word = "".join(rng.choice(_ONSETS) + rng.choice(_VOWELS) + (rng.choice(_CODAS) if rng.random() < 0.5 else "") for _ in range(syllables))
    return word.capitalize()


def vary(text: str, spans: list[tuple[int, int, str]], rng: random.Random, names: Names) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with other values in its spans: other digits, and for some people other or coined names."""
    parts, out, at, shift = [], [], 0, 0
    for a, b, kind in spans:
        value = text[a:b]
        if kind in ("phone", "id_number", "address") and rng.random() < 0.7:
            value = re.sub(r"(?<![+\d])\d|(?<=\d)\d(?=\d)|\d$", lambda m: str(rng.randint(0, 9)) if m.start() > 2 else m[0], value)
        elif kind == "person" and rng.random() < 0.7:
            def other(m: re.Match) -> str:
                if len(m[0]) < 3:
                    return m[0]
                new = _coined(rng, rng.choice((1, 2, 2, 3))) if rng.random() < 0.6 else rng.choice(sorted(names.first if m[0] in names.first else names.last) or [m[0]])
                return new.upper() if m[0].isupper() else new
            value = re.sub(rf"[{_UP}][{_UP}{_LOW}]+", other, value)
        parts += [text[at:a], value]
        out.append((a + shift, a + shift + len(value), kind))
        shift += len(value) - (b - a)
        at = b
    return "".join([*parts, text[at:]]), out


def windows_of(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(codes, tags) of every window that the tagger would read."""
    codes = encode(text)
    tags = np.zeros(len(text), dtype=np.int8)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        tags[a:b] = 2 + 2 * k
        tags[a] = 1 + 2 * k
    return [(codes[a:b], tags[a:b]) for a, b in cut(stretches(text))]


def _share(task: tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    weights, codes, tags = task
    return Tagger(weights).gradient(codes, tags, None)


def train(texts: list[str], seed: int = 3, say=print, start: Tagger | None = None) -> Tagger:
    """Fit on nine tenths of the texts; the loss and exact matches on the others are reported."""
    rng = random.Random(seed)
    names = Names(texts, max(1, round(3 * len(texts) / DOCUMENTS)))  # in a small sample most surnames stand once
    say(f"{len(names.first)} first names, {len(names.last)} surnames")
    some, none, held = [], [], []
    for n, text in enumerate(texts):
        spans = label(text, names)
        if n % 10 == 0:
            held += windows_of(text, spans)
            continue
        plain = windows_of(text, spans)
        if spans:
            for _ in range(COPIES):
                some += [w for w in windows_of(*vary(text, spans, rng, names)) if w[1].any()]
            some += [w for w in plain if w[1].any()]
        none += [w for w in plain if not w[1].any()]
    made = [w for text, spans in composed(rng, _coined, COMPOSED) for w in windows_of(text, spans)]
    rng.shuffle(some)
    rng.shuffle(none)
    own = (made + some)[: WINDOWS // 3]
    fill = WINDOWS - len(own)
    say(f"{len(made)} windows of sentences written by hand")
    say(f"{len(some)} windows with spans, {len(none)} without, {len(own)} of them and others up to {WINDOWS} in a pass, {len(held)} held out")
    tagger, passes, most = (Tagger.fresh(HIDDEN), PASSES, 1.0) if start is None else (start, MORE_PASSES, MORE_SCALE)
    adam = Adam(tagger.w)
    steps = passes * ((len(own) + min(fill, len(none))) // STEP_SIZE + 1)
    done, began = 0, time.time()
    with Pool(WORKERS) as pool:
        for epoch in range(passes):
            at = epoch * fill % max(1, len(none))
            data = own + (none[at:] + none[:at])[:fill]
            rng.shuffle(data)
            total = 0.0
            for k in range(0, len(data), STEP_SIZE):
                part = sorted(data[k : k + STEP_SIZE], key=lambda w: len(w[0]))
                codes = np.full((len(part), WINDOW), PAD, dtype=np.uint8)
                tags = np.zeros((len(part), WINDOW), dtype=np.int8)
                for r, (c, t) in enumerate(part):
                    codes[r, : len(c)], tags[r, : len(t)] = c, t
                shares = [(len(codes[i::WORKERS]) / len(part), (tagger.w, codes[i::WORKERS], tags[i::WORKERS])) for i in range(min(WORKERS, len(part)))]
                found = pool.map(_share, [task for _, task in shares], chunksize=1)
                grads = {key: sum(x * g[key] for (x, _), (_, g) in zip(shares, found)) for key in tagger.w}
                adam.update(tagger.w, grads, scale=most * max(0.03, 1 - done / steps))
                total += sum(x * loss for (x, _), (loss, _) in zip(shares, found))
                done += 1
            say(f"pass {epoch + 1}: loss {total / (len(data) // STEP_SIZE + 1):.3f}, {time.time() - began:.0f} s, held out: {score(tagger, held[:8000])}")
    return tagger


def score(tagger: Tagger, windows: list[tuple[np.ndarray, np.ndarray]]) -> str:
    """Windows whose tags are all right, among those with spans and those without."""
    right, seen = Counter(), Counter()
    for k in range(0, len(windows), 512):
        part = windows[k : k + 512]
        codes = np.full((len(part), WINDOW), PAD, dtype=np.uint8)
        for r, (c, _) in enumerate(part):
            codes[r, : len(c)] = c
        found = tagger.tag(codes)
        for r, (c, t) in enumerate(part):
            what = "with" if t.any() else "without"
            seen[what] += 1
            right[what] += bool((found[r, : len(c)] == t).all())
    return ", ".join(f"{w} {right[w]}/{seen[w]}" for w in seen)


def main(out: str, paths: list[str]) -> None:
    import pyarrow.parquet as pq

    start = None
    if paths[0] == "--start":
        start, paths = Tagger.load(paths[1]), paths[2:]
    texts: list[str] = []
    for path in paths:
        texts += [t for t in pq.read_table(path, columns=["text"]).column("text").to_pylist() if t]
    train(texts[:DOCUMENTS], seed=3 if start is None else 4, start=start).save(out)  # weights that are given see other values


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

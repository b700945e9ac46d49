"""Languages of documents and of their parts (problem 2).

A linear-chain conditional random field labels words. Its emissions are sums of hashed affix, n-gram
and lexicon features, its transitions are learned on code-switched sequences, and forward-backward
gives each word's language probabilities. A sentence takes the language with the largest mean; where
the words' probabilities switch inside a sentence, it is cut there. A sentence that stays unsure is
judged again in one sequence with its neighbours, so that the learned transitions carry over. Words
of languages beside the nine fall to the label "other".

The field is trained here, on sentences of the corpus itself: a bounded sample whose weak labels
come from the function words below, and from the stated language where it agrees.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

LANGS = ["en", "de", "fr", "es", "it", "nl", "pt", "pl", "ru", "other"]
OTHER = LANGS.index("other")
BITS = 17

# How records state a language, beside its two-letter code.
STATED = {
    "eng": "en", "english": "en", "anglais": "en", "englisch": "en", "inglés": "en",
    "deu": "de", "ger": "de", "german": "de", "deutsch": "de", "allemand": "de",
    "fra": "fr", "fre": "fr", "french": "fr", "français": "fr", "francais": "fr", "französisch": "fr",
    "spa": "es", "spanish": "es", "español": "es", "espanol": "es", "castellano": "es", "spanisch": "es",
    "ita": "it", "italian": "it", "italiano": "it", "italienisch": "it",
    "nld": "nl", "dut": "nl", "dutch": "nl", "nederlands": "nl", "flemish": "nl",
    "por": "pt", "portuguese": "pt", "português": "pt", "portugues": "pt",
    "pol": "pl", "polish": "pl", "polski": "pl",
    "rus": "ru", "russian": "ru", "русский": "ru",
}
# Common function words.
FUNCTION_WORDS = {
    "en": "the of and to in is that for you we our your with are be or not may this by on as if will can from it us has have do when which than about at their any more who what how",
    "de": "der die das und wir sie ihre ihr ihren nicht mit für ist den dem des ein eine einen von zu auf an auch wenn bei oder werden uns sich im aus als nach über um keine haben wird es durch können",
    "fr": "le la les des et nous vous votre vos pour dans est une un que qui sur pas avec au aux du ces sont par ne de en ce il cette leur leurs nos notre ou mais même toute à à",
    "es": "el la los las y de que en un una para con su sus por no se si usted nosotros del al más como esta está nuestro lo o nunca puede pero según sin también cuando a sobre este todo cualquier otros en cuanto le antes momento dos",
    "it": "il lo la gli le e di che per con un una non sono si della del dei nel nostro tuoi tuo tua ogni su delle alla al da i in anche più questa perché tu ti puoi o quando gli",
    "nl": "de het een en van wij u uw niet met voor is op dat zijn aan te of om ook deze naar bij geen ons onze worden dan door als in kunt over nooit",
    "pt": "o a os as e de que para com um uma não se do da dos das no na em por seu sua você ao são mais nos nosso sobre pelo pela também nunca sem pode esta este ou quando qualquer todo sobre estas estes quanto antes momento dois em caso",
    "pl": "i w na do nie z że się jest lub oraz dla przez o po za ich tej od aby jak nasz państwa także również można każdej co czy być tym przy jeśli ani bez",
    "ru": "и в на не мы вы для по с от или что это как при о об за к до чем ваш вашего можете также если никогда без наш его их нас этом чтобы менее",
}
# Common words of languages beside the nine (Swedish, Danish and Norwegian, Finnish, Czech, Hungarian, Romanian, Turkish, Croatian, Catalan, Latin letters of Vietnamese, Greek).
OTHER_WORDS = {
    "sv": "och att det som en på är av för med den till inte om ett har vi kan ska dina uppgifter du när eller från vår våra personuppgifter delar aldrig utan samtycke tjänster användare behandlar lagrar adress också",
    "da": "og at det som en på er af for med den til ikke om et har vi kan skal dine oplysninger du når eller fra vores ikke personoplysninger deler aldrig uden samtykke tjenester brugere behandler gemmer adresse også hvis",
    "fi": "ja on ei se että me voimme tietoja tietojasi kun tai joka ovat sekä emme käytämme palvelun käyttäjät henkilötietoja sivuston mukaan niitä myös jos vain ilman suostumusta osoite koskaan keräämme",
    "cs": "a že je v na se nebo které jsou pro údaje vaše když osobní můžeme služby také podle jejich není uživatelé souhlas bez nikdy sdílíme adresu shromažďujeme pokud tyto nás vám při až",
    "hu": "és hogy az nem egy van vagy adatok adatait személyes amikor szolgáltatás felhasználók is csak lehet ezek nélkül hozzájárulás soha gyűjtjük megosztjuk címét ha önnek mi által kezelése szerint között",
    "ro": "și că este în pe se sau care sunt pentru datele dumneavoastră când personale putem servicii de asemenea nu utilizatorii fără consimțământ niciodată colectăm adresa dacă aceste noastre cu prin mai din",
    "tr": "ve bir bu için ile olarak veya kişisel verileri olan daha hizmet kullanıcı gibi değil onay olmadan asla topluyoruz paylaşıyoruz adresiniz eğer bizim tarafından zaman göre kadar sonra verilerinizi",
    "hr": "je u na se ili koje su za podatke vaše kada osobne možemo usluge također prema nije korisnici bez privole nikada dijelimo adresu prikupljamo ako ove nas kako što biti njihove",
    "ca": "i que és en el la amb per als les dades vostres quan personals podem serveis també segons usuaris sense consentiment mai compartim adreça recollim si aquestes nostres aquest però més fins",
    "el": "και το να είναι της για την με που δεν τα δεδομένα σας όταν προσωπικά μπορούμε υπηρεσίες επίσης χρήστες χωρίς συγκατάθεση ποτέ συλλέγουμε διεύθυνση εάν αυτά μας",
}
_NINE = {w for ws in FUNCTION_WORDS.values() for w in ws.split()}
FUNCTION_WORDS["other"] = " ".join(sorted({w for ws in OTHER_WORDS.values() for w in ws.split()} - _NINE))
LEXICON: dict[str, set[int]] = defaultdict(set)
for _k, _lang in enumerate(LANGS):
    for _w in FUNCTION_WORDS[_lang].split():
        LEXICON[_w].add(_k)

WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|\d+|[^\w\s]")
LETTERS = re.compile(r"[^\W\d_]")
ADDRESS = re.compile(r"\S*@\S+|https?://\S+|\b[\w-]+(?:\.[\w-]+)+\b")
CLOSED = re.compile(r"[.!?…]\W*\Z")
# Begins with the sign or line end itself, for which the search skips ahead; the sign still belongs to the sentence.
BREAK = re.compile(r"[.!?…\r\n](?:(?<=[.!?…])(?<!\bArt\.)(?<!\bNr\.)(?<!\bno\.)[\"”’»)\]]*\s+(?![a-zß-öø-ÿа-яё])|(?<=[\r\n])[\r\n]*)")


def fold(word: str) -> str:
    """The word without accents."""
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def word_features(word: str) -> list[int]:
    """Hashed features of a lower-case word."""
    f = fold(word)
    out = ["w" + word, "f" + f]
    if word.isalpha() or "'" in word or "’" in word or "-" in word:
        out += [f"p{f[:2]}", f"p{f[:3]}", f"s{f[-2:]}", f"s{f[-3:]}", f"s{f[-4:]}"]
        p = f"^{f}$"
        out += ["g" + p[i : i + 3] for i in range(len(p) - 2)]
        out += ["a" + c for c in word if ord(c) > 127]
        out += [f"l{k}" for k in LEXICON.get(word, ())]
        out += [f"k{len(word)}"] if len(word) < 3 else []
    else:
        out = ["0" if word.isdigit() else "," + word[:1]]
    return [zlib.crc32(x.encode()) & ((1 << BITS) - 1) for x in out]


class Chunks(dict):
    """What stands between white space -> its words, numbers and signs; filled as texts come."""

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        if len(self) > 100_000:
            self.clear()
        t = self[chunk] = tuple(WORD.findall(chunk))
        return t


CHUNKS = Chunks()


def tokens(sentence: str) -> list[str]:
    """Lower-case words, numbers (as 0) and signs; addresses are left out."""
    return [("0" if t[0].isdigit() else t) for t in raw_tokens(sentence)]


def raw_tokens(sentence: str) -> list[str]:
    """``tokens`` with numbers as they are; a field takes each of them as 0 itself."""
    if "@" in sentence or "." in sentence[:-1]:
        sentence = ADDRESS.sub(" ", sentence)
    return list(chain.from_iterable(map(CHUNKS.__getitem__, sentence.lower().split())))


def sentences(text: str) -> list[str]:
    """The pieces between sentence ends and line ends; never empty ones."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        i, end = m.span()
        out.append(text[at : i if text[i] in "\r\n" else i + 1].strip())
        at = end
    out.append(text[at:].strip())
    return [s for s in out if s]


def weights(e: np.ndarray) -> np.ndarray:
    """The exponentials of emissions, the largest of each word as 1."""
    return np.exp(e - e.max(1, keepdims=True))


class Numbers(dict):
    """Word -> its number, filled as words come; all words that are numbers themselves have that of 0."""

    def __init__(self) -> None:
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        if word != "0" and word[0].isdigit():
            n = self[word] = self["0"]
            return n
        n = self[word] = len(self.words)
        self.words.append(word)
        return n


class Field:
    """Linear-chain conditional random field over ``LANGS``."""

    def __init__(self) -> None:
        self.w = np.zeros((1 << BITS, len(LANGS)), np.float32)
        self.t = np.zeros((len(LANGS), len(LANGS)))
        self.ids: dict[str, list[int]] = {}
        self.forget()

    def __getstate__(self):
        return {"w": self.w, "t": self.t, "ids": {}}

    def __setstate__(self, s):
        self.__dict__.update(s)
        self.forget()

    def forget(self) -> None:
        """Drops what is kept of words by number: the exponentials of their emissions and whether they are letters."""
        self.numbers = Numbers()
        self.weight, self.letters = np.zeros((0, len(LANGS)), np.float32), np.zeros(0, bool)

    def feats(self, word: str) -> list[int]:
        f = self.ids.get(word)
        if f is None:
            f = self.ids[word] = word_features(word)
        return f

    def numbered(self, seqs: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of the words of all sequences, the lengths of these); ``weight`` and ``letters`` then hold every number."""
        if len(self.numbers) > 400_000:
            self.forget()
        lens = np.fromiter(map(len, seqs), np.int64, len(seqs))
        flat = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(seqs)), np.int64, int(lens.sum()))
        words, parts = self.numbers.words, [self.weight]
        for s in range(len(self.weight), len(words), 8192):
            f = [word_features(x) for x in words[s : s + 8192]]
            n = np.array([len(r) for r in f])
            e = np.add.reduceat(self.w[list(chain.from_iterable(f))], np.r_[0, np.cumsum(n)[:-1]]) / np.sqrt(n)[:, None]
            parts.append(weights(e.astype(np.float32)))
        if len(parts) > 1:
            self.letters = np.r_[self.letters, np.fromiter((x[0].isalpha() for x in words[len(self.weight) :]), bool)]
            self.weight = np.concatenate(parts)
        return flat, lens

    def posteriors(self, seqs: list[list[str]], emissions: list[np.ndarray] | None = None, pairs: bool = False):
        """Word-by-language probabilities of each sequence (and expected transitions), by forward-backward."""
        if emissions is None:
            flat, lens = self.numbered(seqs)
            every, trans = self.marginals(self.weight, flat, lens, pairs)
        else:
            lens = np.array([len(q) for q in seqs], np.int64)
            every, trans = self.marginals(weights(np.concatenate(emissions)), np.arange(lens.sum()), lens, pairs)
        ends = np.cumsum(lens)
        out = [every[e - n : e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
        return (out, trans) if pairs else out

    def marginals(self, weight: np.ndarray, flat: np.ndarray, lens: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the languages at each word of the sequences, one after the other, and expected transitions.

        ``flat`` has the row of ``weight`` of each word. Sequences of like length run together, with
        the sequences along the last axis, so that each step is a few operations on whole rows; sums
        are rescaled at each step, so length is no limit.
        """
        k = len(LANGS)
        et = np.exp(self.t - self.t.max()).astype(weight.dtype)
        back, starts = np.ascontiguousarray(et.T), np.cumsum(lens) - lens
        out, trans = np.empty((len(flat), k), weight.dtype), np.zeros((k, k))
        order = np.argsort(lens, kind="stable")
        inorder = lens[order]
        s = int(np.searchsorted(inorder, 0, "right"))
        while s < len(order):
            size = max(1, min(1024, 120_000 // int(inorder[s])))
            stop = min(s + size, int(np.searchsorted(inorder, 2 * inorder[s] + 8, "right")))
            block, n = order[s:stop], inorder[s:stop]
            s, m = stop, int(inorder[stop - 1])
            at = starts[block] + np.arange(m)[:, None]
            e = np.ascontiguousarray(weight[flat[np.minimum(at, len(flat) - 1)]].transpose(0, 2, 1))
            a, b = np.empty_like(e), np.ones_like(e)
            a[0] = e[0] / e[0].sum(0)
            for j in range(1, m):
                x = back @ a[j - 1]
                x *= e[j]
                np.divide(x, x.sum(0), out=a[j])
            live = np.searchsorted(n, np.arange(m + 1), "right")  # the first sequence longer than that
            for j in range(m - 2, -1, -1):
                f = live[j + 1]
                x = et @ (e[j + 1, :, f:] * b[j + 1, :, f:])
                np.divide(x, x.sum(0), out=b[j, :, f:])
                if pairs:
                    y = e[j + 1, :, f:] * b[j + 1, :, f:]
                    trans += et * ((a[j, :, f:] / (a[j, :, f:] * (et @ y)).sum(0)) @ y.T)
            a *= b
            a /= a.sum(1, keepdims=True)
            inside = np.arange(m)[:, None] < n
            out[at[inside]] = a.transpose(0, 2, 1)[inside]
        return out, trans

    def fit(self, seqs: list[list[str]], labels: list[np.ndarray], epochs: int = 5, rate: float = 0.5, l2: float = 1e-4, batch: int = 256) -> Field:
        """Maximum conditional likelihood by Adagrad on minibatches."""
        k = len(LANGS)
        g2, gt2 = np.full(self.w.shape, 1e-6, np.float32), np.full((k, k), 1e-2)
        rng, order = np.random.default_rng(0), np.arange(len(seqs))
        for _ in range(epochs):
            rng.shuffle(order)
            for s in range(0, len(order), batch):
                part = [seqs[i] for i in order[s : s + batch]]
                truth = [labels[i] for i in order[s : s + batch]]
                words = {x: None for q in part for x in q}
                for j, x in enumerate(words):
                    words[x] = j
                f = [self.feats(x) for x in words]
                flat = np.array([i for r in f for i in r])
                owner = np.repeat(np.arange(len(f)), [len(r) for r in f])
                scale = 1 / np.sqrt([len(r) for r in f])
                table = np.add.reduceat(self.w[flat], np.r_[0, np.cumsum([len(r) for r in f])[:-1]]).astype(float) * scale[:, None]
                index = [np.array([words[x] for x in q]) for q in part]
                post, trans = self.posteriors(part, [table[i] for i in index], pairs=True)
                at, y, d = np.concatenate(index), np.concatenate(truth), np.concatenate(post)
                d[np.arange(len(y)), y] -= 1
                ge = np.stack([np.bincount(at, d[:, j], len(f)) for j in range(k)], 1) * scale[:, None]
                last = np.cumsum([len(q) for q in part])[:-1]
                inner = np.setdiff1d(np.arange(len(y) - 1), last - 1)
                gt = trans - np.bincount(y[inner] * k + y[inner + 1], minlength=k * k).reshape(k, k)
                u, inv = np.unique(flat, return_inverse=True)
                gw = np.stack([np.bincount(inv, ge[owner, j], len(u)) for j in range(k)], 1) + l2 * self.w[u]
                g2[u] += gw**2
                self.w[u] -= (rate * gw / np.sqrt(g2[u])).astype(np.float32)
                gt2 += gt**2
                self.t -= 0.1 * gt / np.sqrt(gt2)
                self.t = np.clip(self.t, -6, 6)
        self.forget()
        return self


def stated_index(lang: str | None) -> str | None:
    """The language that a record's own ``lang`` states; None if it states nothing."""
    if lang is None:
        return None
    t = lang.strip().lower()
    if t in ("", "und", "unknown", "none", "null", "n/a", "mul", "zxx"):
        return None
    return STATED.get(t) or STATED.get(re.split(r"[-_ ]", t)[0]) or re.split(r"[-_ ]", t)[0]


CYRILLIC = re.compile("[а-я]")


def vote(words: list[str]) -> int | None:
    """The language whose function words clearly lead in a sentence."""
    v = [0.0] * len(LANGS)
    for w in words:
        ks = LEXICON.get(w)
        if ks:
            for k in ks:
                v[k] += 1 / len(ks)
    if CYRILLIC.search(" ".join(words)):
        v[LANGS.index("ru")] += 3
    second, first = sorted(v)[-2:]
    return v.index(first) if first >= 1.5 and first >= 1.5 * second + 0.2 else None


PER_LANGUAGE = 2_500  # distinct sentences of each language on which the field is fitted, at most


def labelled_sentences(sample: pd.DataFrame) -> pd.DataFrame:
    """(label, words) of the distinct sentences of (text, lang) rows whose function words clearly lead.

    Where the record states another language, half of them, by a hash, are left out.
    """
    out: dict[str, int] = {}
    seen: set[str] = set()
    for text, lang in zip(sample["text"], sample["lang"], strict=True):
        if not isinstance(text, str):
            continue
        own = stated_index(lang if isinstance(lang, str) else None)
        for s in sentences(text):
            if s in seen:
                continue
            seen.add(s)
            w = tokens(s)
            k = vote(w)
            if k is None or len([x for x in w if x.isalpha()]) < 5:
                continue
            if own is not None and own in LANGS and LANGS[k] != own and zlib.crc32(s.encode()) & 1:
                continue
            out.setdefault(" ".join(w), k)
    return pd.DataFrame({"label": list(out.values()), "words": list(out)})


def sampled_sentences(df: DataFrame) -> pd.DataFrame:
    """``labelled_sentences`` of a sample of (text, lang) rows, found in the tasks; ``PER_LANGUAGE`` of each language, by a hash, come to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield labelled_sentences(b).astype({"label": "int32"})

    s = df.select("text", "lang").mapInPandas(run, "label int, words string").distinct()
    w = Window.partitionBy("label").orderBy(F.xxhash64("words"), "words")
    return s.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= PER_LANGUAGE).drop("_n").toPandas()


def train(sample: pd.DataFrame) -> Field:
    """A field from (text, lang) rows, or from ``labelled_sentences``; at most ``PER_LANGUAGE`` of each language.

    The function words themselves are always part of the training, so a language that the sample
    lacks keeps its lexicon. Sequences join one to three sentences, often of different languages;
    a third lose their accents, as such texts occur.
    """
    rng = np.random.default_rng(0)
    known = sample if "label" in sample.columns else labelled_sentences(sample)
    known = known.drop_duplicates("words").sort_values(["label", "words"]).groupby("label").head(PER_LANGUAGE)
    pool = [(int(k), w.split(" ")) for k, w in zip(known["label"], known["words"], strict=True)]
    for lang, ws in [*FUNCTION_WORDS.items(), *OTHER_WORDS.items()]:
        k, lex = LANGS.index(lang) if lang in LANGS else OTHER, ws.split()
        for _ in range(60):
            pool.append((k, [lex[i] for i in rng.integers(0, len(lex), 8)]))
    rng.shuffle(pool)
    seqs, labels, i = [], [], 0
    while i < len(pool):
        n = int(rng.integers(1, 4))
        part = pool[i : i + n]
        i += n
        w = [x for _, q in part for x in q]
        if rng.random() < 0.33:
            w = [fold(x) for x in w]
        seqs.append(w)
        labels.append(np.array([k for k, q in part for _ in q]))
    return Field().fit(seqs, labels)


Verdict = tuple[int, float, int, tuple[tuple[int, int, float, int], ...]]
SURE = 0.6  # below this mean a sentence is judged again with its neighbours


def switches(piece: str, toks: list[str], g: np.ndarray, main: int, least: int, sure: float) -> tuple[tuple[int, int, float, int], ...]:
    """(start, language, confidence, words) of the runs of a sentence whose words' probabilities switch; () for none.

    Each word is taken with the two before and after it. A run counts if at least ``least`` words of it in a row are another language's, with the mean
    probability ``sure``; runs of fewer words belong to their surroundings.
    """
    real = np.array([t[0].isalpha() and len(t) > 1 for t in toks])
    at = np.flatnonzero(real)
    if len(at) < 2 * least:
        return ()
    sums = np.cumsum(np.r_[np.zeros((1, g.shape[1])), g[at]], 0)
    near = np.arange(len(at))
    b = (sums[np.minimum(near + 3, len(at))] - sums[np.maximum(near - 2, 0)]).argmax(1)
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
    runs = [(int(s), int(e), int(b[s])) for s, e in zip(cuts, cuts[1:]) if e - s >= least and g[at[s:e], b[s]].mean() >= sure]
    if all(k == main for _, _, k in runs):
        return ()
    merged: list[list[int]] = []
    for s, _, k in runs:
        if not merged or merged[-1][1] != k:
            merged.append([s if merged else 0, k])
    if len(merged) < 2:
        return ()
    places = [m.start() for m in WORD.finditer(ADDRESS.sub(lambda m: " " * len(m.group()), piece) if "@" in piece or "." in piece[:-1] else piece)]
    ends = [s for s, _ in merged[1:]] + [len(at)]
    return tuple((0 if i == 0 else places[at[s]], k, float(g[at[s:e], k].mean()), e - s) for i, ((s, k), e) in enumerate(zip(merged, ends, strict=True)))


def judge(field: Field, pieces: list[str], least: int = 4, sure: float = 0.7) -> list[Verdict]:
    """(language, confidence, words, switches) of each sentence; language -1 without words."""
    toks = [raw_tokens(p) for p in pieces]
    if not toks:
        return []
    flat, lens = field.numbered(toks)
    real = field.letters[flat]
    owner = np.repeat(np.arange(len(toks)), lens)[real]
    every, _ = field.marginals(field.weight, flat, lens)
    g = every[real]
    n = np.bincount(owner, minlength=len(toks))
    sums = np.stack([np.bincount(owner, g[:, k], len(toks)) for k in range(len(LANGS))], 1)
    best = sums.argmax(1)
    conf = sums[np.arange(len(toks)), best] / np.maximum(1, n)
    strange = np.bincount(owner, g.argmax(1) != best[owner], len(toks)) >= least
    ends = np.cumsum(lens)
    out = []
    for i, (k, c, m) in enumerate(zip(best.tolist(), conf.tolist(), n.tolist(), strict=True)):
        out.append((k, c, m, switches(pieces[i], toks[i], every[ends[i] - lens[i] : ends[i]], k, least, sure) if strange[i] else ()) if m else (-1, 0.0, 0, ()))
    return out


def judge_in_text(field: Field, texts: list[list[str]], verdicts: list[list[Verdict]]) -> None:
    """Judges each unsure sentence again in one sequence with its neighbours, in place."""
    where, seqs, span = [], [], []
    for d, (ks, vs) in enumerate(zip(texts, verdicts, strict=True)):
        for i, v in enumerate(vs):
            if v[0] >= 0 and v[1] < SURE and len(ks) > 1:
                before, own, after = tokens(ks[i - 1]) if i else [], tokens(ks[i]), tokens(ks[i + 1]) if i + 1 < len(ks) else []
                where.append((d, i))
                seqs.append(before + own + after)
                span.append((len(before), len(before) + len(own)))
    if not seqs:
        return
    for (d, i), q, (s, e), g in zip(where, seqs, span, field.posteriors(seqs), strict=True):
        real = np.array([x[0].isalpha() for x in q[s:e]])
        mean = g[s:e][real].mean(0)
        k = int(mean.argmax())
        verdicts[d][i] = (k, float(mean[k]), int(real.sum()), ())


PARTS = "part int, first int, last int, lang string, confidence double, words int, full boolean"


def label_parts(df: DataFrame, field: Field, key: list[str], text: str = "text", closed: bool = True, least_words: int = 6) -> DataFrame:
    """One row for each part of a text that is in one language: ``key``, part, first, last, lang, ...

    first and last are character positions of a run of sentences, or of pieces of a sentence that
    switches, in one language ("other" for none of the nine); confidence is the mean probability of
    their words; words counts them; full tells that at least one of the sentences is a full one: of
    ``least_words`` words or more and, if ``closed``, with a sentence end. Pieces without words join
    no part; null, empty and blank texts have no rows. Map-side only; equal sentences of a task are
    judged once.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)
    fields = [df.schema[c] for c in key]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + PARTS
    names = [*key, "part", "first", "last", "lang", "confidence", "words", "full"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Verdict] = {}
        digits = re.compile("[1-9]")
        for b in batches:
            even = [digits.sub("0", t) if isinstance(t, str) else "" for t in b[text]]
            keys = [sentences(t) for t in even]
            new = list({s for ks in keys for s in ks if s not in known})
            if len(known) > 300_000:
                known.clear()
                new = list({s for ks in keys for s in ks})
            for s, v in zip(new, judge(shared.value, new), strict=True):
                known[s] = v
            verdicts = [[known[s] for s in ks] for ks in keys]
            judge_in_text(shared.value, keys, verdicts)
            rows = []
            for ids, t, ks, vs in zip(b[key].itertuples(index=False, name=None), even, keys, verdicts, strict=True):
                at, part, run_ = 0, 0, None
                for s, (k, conf, n, cut) in zip(ks, vs, strict=True):
                    at = t.find(s, at)
                    if k >= 0:
                        full = n >= least_words and conf >= 0.5 and (not closed or s[-1] in ".!?…" or bool(CLOSED.search(s)))
                        if not cut and run_ and run_[2] == k:
                            at += len(s)
                            run_[1], run_[3], run_[4], run_[5] = at, run_[3] + conf * n, run_[4] + n, run_[5] or full
                            continue
                        starts = [at + c[0] for c in cut[1:]] + [at + len(s)]
                        for (first, lang, sure, words), last in zip(cut or ((0, k, conf, n),), starts, strict=True):
                            if run_ and run_[2] == lang:
                                run_[1], run_[3], run_[4], run_[5] = last, run_[3] + sure * words, run_[4] + words, run_[5] or (full and lang == k)
                            else:
                                if run_:
                                    rows.append((*ids, part, run_[0], run_[1], LANGS[run_[2]], run_[3] / run_[4], run_[4], run_[5]))
                                    part += 1
                                run_ = [at + first, last, lang, sure * words, words, full and lang == k]
                    at += len(s)
                if run_:
                    rows.append((*ids, part, run_[0], run_[1], LANGS[run_[2]], run_[3] / run_[4], run_[4], run_[5]))
            yield pd.DataFrame(rows, columns=names)

    return df.select(*key, text).mapInPandas(run, schema)


def stated(c: Column) -> Column:
    """Column form of ``stated_index``."""
    t = F.lower(F.trim(c))
    base = F.element_at(F.split(t, r"[-_ ]"), 1)
    names = F.create_map(*[F.lit(x) for kv in STATED.items() for x in kv])
    return F.when(t.isNull() | t.isin("", "und", "unknown", "none", "null", "n/a", "mul", "zxx"), F.lit(None).cast("string")).otherwise(F.coalesce(names[t], names[base], base))

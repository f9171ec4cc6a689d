"""Problem 8: template residue and error-page text.

A text is cut into segments: its lines, and lines that no rule knows into sentences. A first title and a last footer line
are set aside. Trusted labels come from a list of labelled examples and from rules; a document without content is one
whose segments are all labelled, at least one of them as residue. Most wordings are in no list, so labels spread over
the graph of similar segments:

1. Segments (numbers and ids masked) get a 64-bit SimHash of their n-grams and are looked up in tables keyed by pairs of
   its PIECES pieces and by size. Hashes up to PIECES - 2 bits apart agree on such a pair for certain, others by chance;
   pairs up to HAMMING bits apart are kept. (Recall against all pairs is measured in the tests and given in the README.)
2. Candidates are verified by the Jaccard similarity of the n-grams.
3. Labels run through the connected components, from the labelled segments out: only segments near a labelled one are
   compared, so the tables meet a small side. A component with a residue label is residue, one with only labels of
   accompanying text ("check back later") is such text.

A document needs all its segments labelled, so only its longest unknown one meets the tables at first; the others follow
where that one got a label. Placeholders are found by rules on running text (code, quotations and traceback frames are
removed first) and never spread: the same text with its values filled in is a good record.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from closura.llm.leakage import spread
from closura.plans.staging import Stage

HAMMING, PIECES, GRAM, SIMILAR = 18, 12, 4, 0.8
#: Lines of more words are judged sentence by sentence.
LINE = 40

# --- placeholders -------------------------------------------------------------------------------------------------
_NAME = r"[A-Za-z][A-Za-z0-9_ .-]{0,40}"
PLACEHOLDER = re.compile(
    "|".join([
        r"\{\{\s*" + _NAME + r"\s*\}\}", r"\{%-?\s*" + _NAME + r"\s*-?%\}", r"<%=?\s*" + _NAME + r"\s*%>", r"[$#]\{" + _NAME + r"\}", r"(?<![\w$])\$[A-Za-z][A-Za-z_]*\$(?![\w$])",
        r"%\([A-Za-z]\w*\)[sdrf]", r"(?<!\w)__[A-Z][A-Z0-9_]*?__(?!\w)", r"@@" + _NAME + r"@@", r"\[\[" + _NAME + r"\]\]", r"\[(?:INSERT|ENTER|ADD|YOUR)\b[^\]\n]{0,60}\]",
        r"\[[^\]\n]{1,60} (?:goes|go) here\]", r"(?i:<(?:your|insert|enter|add)\b[^<>\n]{1,60}>)", r"(?<!\w)(?:TBD|TBA|TODO|FIXME)\([A-Za-z][A-Za-z_ ]*\)", r"(?<!\w)TK TK(?!\w)", r"(?<![\w%])%[A-Z][A-Z_]{3,}%(?![\w%])", r"(?i:(?:dear|hello|hi|hallo|liebe[r]?|bonjour|estimad[oa]|ciao)) \[[A-Z][A-Za-z ]{1,30}\](?![(\[])",
        r"(?<![\w>.`])<(?P<tag>[A-Za-z][A-Za-z_]*(?: [a-z_]+){0,3})>(?!\w)", r"(?<![\w{$#%])\{[A-Za-z][A-Za-z]*(?:_[A-Za-z]+)*\}(?!\})",
    ])
)
_HINT = re.compile(r"[{<\[$]|%\(|%[A-Z]{2}|__[A-Z]|@@|(?:TBD|TBA|TODO|FIXME)\(|TK TK")
HTML = frozenset("a abbr article aside b blockquote body br button caption center code col dd details div dl dt em fieldset figure font footer form frame h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label legend li link main meta nav noscript object ol optgroup p param pre q s samp script section select small span strike strong style sub summary sup svg table tbody td textarea tfoot th thead tr tt u ul var video".split())
FRAMES = frozenset("module lambda string stdin listcomp genexpr dictcomp setcomp locals frozen".split())
_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[ \t]*$|\Z)", re.S | re.M)
_QUOTED = re.compile(r"``[^`]*``|`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|(?<!\w)'[^'\n]*'(?!\w)")
_CODE = re.compile(
    r"^(?:\s{4}|\t|> ?|>>> |\.\.\. |\$ |(?:async )?def \w|class \w[\w(), =.]*:|(?:return|yield|raise|assert|del|global|await)\b[^.]*$|(?:for|if|elif|while|with)\b.*:$|(?:try|else|finally):$|except\b.*:$|from \S+ import |import \w|@\w|File \"|  File \"|Traceback |[\w.\[\]\"', ]+ [-+*/|&]?= |[\w.]+\(.*\)$)"
)


def placeholder(text: str) -> bool:
    """A placeholder in running text, outside of code and quotations."""
    if not _HINT.search(text):
        return False
    text = _FENCE.sub("\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    prose = "\n".join(x for x in text.split("\n") if not _CODE.match(x))
    for m in PLACEHOLDER.finditer(_QUOTED.sub(" ", prose)):
        tag = m.group("tag")
        if tag is None:
            return True
        if tag.lower() not in HTML and tag.lower() not in FRAMES and f"</{tag}>" not in text:
            return True
    return False


# --- filler, error messages and script notices: fixed patterns for whole masked lines or sentences ---------------------
_JS = r"(?:java ?scripts?|scripts?|scripting)"
_ON = r"(?:enabled?|allow(?:ed)?|permit(?:ted)?|activated?|turn(?:ed)? on|switch(?:ed)? on)"
NOTICE = re.compile("|".join([
    r"^(?:please |you (?:need|have) to |you must )?(?:enable|activate|allow|permit|turn on|switch on) " + _JS + r"\b", r"\b(?:need|have|has|must) to " + _ON + r" " + _JS, _JS + r" (?:must|should|has to|have to|needs? to) be " + _ON,
    _JS + r" (?:is|are|was|has been|seems to be) (?:currently )?(?:switched off|disabled|turned off|blocked|required|not enabled|probably blocked)", r"\b(?:has|have) " + _JS + r" (?:disabled|switched off|turned off)", r"\b(?:needs?|requires?) " + _JS + r"(?: to (?:run|work|load|continue))?\b.{0,40}$",
    r"\bwithout " + _JS + r"\b.{0,60}\b(?:cannot|can't|could not|will not|won't) be (?:shown|displayed|loaded|rendered)", r"\b(?:cookies and|and) " + _JS + r" (?:is|are) required",
    r"^(?:bitte )?java ?script (?:bitte )?(?:einschalten|aktivieren|zulassen|erlauben)", r"^bitte java ?script\b", r"java ?script (?:ist )?(?:deaktiviert|ausgeschaltet|nicht aktiviert)", r"^(?:veuillez |merci d[e'] ?)?(?:activer|activez|autoriser) java ?script", r"java ?script est (?:désactivé|requis|nécessaire)",
    r"^(?:por favor,? )?(?:active|activa|habilite|habilita|active usted) java ?script", r"java ?script (?:está )?(?:desactivado|deshabilitado)", r"java ?script (?:muss|sollte) (?:eingeschaltet|aktiviert|zugelassen)", r"\babilita(?:re)? java ?script", r"\b(?:ative|habilite|ativar) o? ?java ?script", r"\bbrowser with java ?script (?:support )?(?:is )?(?:required|needed)", r"browser is not supported",
]))
_STATUS = r"(?:internal server error|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|not found|forbidden|unauthori[sz]ed|bad request|too many requests|request time-?out|payment required|gone|method not allowed|not acceptable|conflict)"
ERROR = re.compile("|".join([
    r"^(?:http |error |erreur |fehler )?#?\s*:?\s*" + _STATUS + r"[.!]?$", r"^(?:http |error |erreur |fehler )(?:code )?#[.!]?$", r"^#{1}$", r"\bpage\b.{0,40}\b(?:does not exist|doesn't exist|not found|has moved|could not be found|cannot be found|no longer exists)", r"^page not found", r"^(?:die )?(?:seite|angeforderte (?:seite|adresse)).{0,40}(?:nicht gefunden|gibt es hier nicht|existiert nicht)",
    r"^page (?:introuvable|non trouvée)", r"cette page n'existe", r"página no (?:encontrada|existe)", r"^access denied", r"\bdo(?:es)? not have permission to (?:view|access|see|open)", r"\b(?:your )?session has (?:ended|expired|timed out)", r"^sign in again", r"^too many requests",
    r"\byou are not a robot\b", r"verify (?:that )?you are (?:a )?human", r"^something went wrong", r"please try again (?:later|in a few)", r"^http # [a-z' -]{2,30}$", r"^(?:the|this) (?:repository|page|document|project|file|site) is (?:currently |temporarily )?unavailable",
    r"^\{\"(?:error|errors|status|code|fault)\":.*\}$", r"^<html>.*<title>(?:#|[^<]*error[^<]*)</title>.*</html>$", r"^(?:the )?(?:server|service) is (?:down|busy|overloaded|temporarily)", r"^(?:the|this) [\w ]{1,30} (?:could not|couldn't|cannot|can't) be (?:loaded|displayed|found|opened|reached)", r"\bis (?:down|closed) for maintenance",
]))
FILLER = re.compile("|".join([
    r"\bno (?:description|summary|documentation|content|text) (?:yet|available|provided)\.?$", r"^(?:coming soon|under construction|content goes here|description goes here|text goes here)[.!]*$",
    r"^(?:[-*+]|#[.)])\s*(?:first|second|third|some|next|another|last|other) (?:point|item|bullet|step|thing|line|entry|element)\.?$",
]))
#: Labelled examples, masked: fixed values. RESIDUE says that there is no content, COMPANION goes along with it.
RESIDUE = """
this page intentionally left blank.|this section is left blank on purpose and will be completed by whoever picks it up.|text for this page has not been written yet.|write the description of this symbol here.
replace this paragraph with your own text.|replace this paragraph with your own words.|content will be added here soon.|this article is a placeholder.|hier steht später die beschreibung.|platzhalter für den späteren text.|texto de relleno.|texto de relleno, sustituir antes de publicar.|texte provisoire, à remplacer.
error establishing a database connection|error establishing a connection to the document store|upstream connect error or disconnect/reset before headers|upstream request timeout|upstream request timeout id=#|no results.
we could not find what you were looking for.|we can't find the page you are looking for.|it looks like nothing was found at this location.|the document # is gone (#).|the requested url was not found on this server.|es posible que el enlace esté roto.
die angeforderte adresse gibt es hier nicht (mehr).|der server antwortet nicht, bitte versuchen sie es später erneut.|erreur # : le serveur ne répond pas, réessayez plus tard.|el servidor no responde, inténtelo de nuevo más tarde.
this repository is unavailable because it was removed or made private (ref #).|the diff could not be loaded.|it may be too large or the service is down for maintenance.|it may be too large or the channel service is down for maintenance.|you have been limited to # calls a minute, slow down and retry after # seconds.
checking that you are not a robot ...|checking your browser before accessing the site.|please wait while the page is rendered on the client.|please wait while the invoice is rendered on the client.|if nothing appears, scripts are probably blocked.
your browser is not supported or has javascript disabled.|you need to enable javascript to run this app.|this site requires javascript and cookies to be enabled.|please turn javascript on and reload the page.
"""
COMPANION = """
check back later.|delete it when you are done.|this takes a moment.|turn it on and reload to see this page.|use a current one to read the thread.|say what it does, what it takes and what it gives back.|sign in again to read this discussion.|enable scripting to continue.
please try again later.|please try again in a few minutes.|retry in #s|retry in # s|vorgang #|ray #|request #|request id: #|reference: #|proxy/#|loading ...|performance and security by the content network|x : type|what x is|what comes back
"""


def examples() -> list[tuple[str, int]]:
    return [(x, label) for text, label in ((RESIDUE, 2), (COMPANION, 1)) for line in text.strip().split("\n") for x in line.split("|")]


#: Words of the usual filler text, and of hands on a keyboard.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum massa augue vitae porta nunc urna justo felis orci erat lacus tellus mauris vestibulum pellentesque morbi tristique senectus netus fames ac turpis egestas donec praesent vivamus".split())
MASH = frozenset("abc aaa bbb ccc ddd xxx yyy zzz qwe rty asd fgh hjkl jkl qwerty asdf qwertz test foo bar baz xyz blah bla".split())
NEUTRAL = re.compile(
    r"^(?:[-=*_#\s|.]+|parameters|returns|raises|yields|examples?|notes?|type|home|index|imprint|impressum|inicio|accueil|startseite|contact|kontakt|help|about|login|log ?in|sign ?in|sign up|log ?out|search|back(?: to \w+)*|menu|oops!?|(?:\(c\)|©|copyright).*|(?:\w+)(?: [|·/>] \w+)+)$"
)
#: Words of which each match of ERROR or FILLER that has words holds one (a quick test before the patterns).
_SIGNS = frozenset("error errors erreur fehler http internal bad service gateway not forbidden unauthorized unauthorised too request payment gone method conflict page seite adresse introuvable trouvée existe encontrada access permission session sign robot human wrong try unavailable status code fault html server could couldn cannot can maintenance no coming under content description text point item bullet step thing line entry element".split())
_MASK = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{5,}\b|\d+(?:[.,:]\d+)*")
_WORDS = re.compile(r"[^\W_]+")


def residue_line(line: str) -> bool:
    """A masked line or sentence of filler, an error message or a script notice."""
    if "noscript>" in line:
        line = re.sub(r"^</?noscript>|</?noscript>$", "", line)
    words = _WORDS.findall(line)
    if len(words) >= 4 and len(set(words)) <= 2:
        return True
    if len(words) >= 4 and not LATIN.isdisjoint(words) and sum(w in LATIN for w in words) >= 0.7 * len(words):
        return True
    if words and len(words) < 4 and LATIN.issuperset(words) and max(map(len, words)) >= 4:
        return True
    if len(words) > LINE:  # judged by its sentences
        return False
    if words and all(w in MASH for w in words) or re.fullmatch(r"#(?: #)+", line):
        return True
    if ("script" in line or "browser" in line) and NOTICE.search(line):
        return True
    return (not words or not _SIGNS.isdisjoint(words)) and bool(ERROR.search(line) or FILLER.search(line))


_TITLE = re.compile(r"^(?:#+ )?[^.?!;]*(?:\.\w[^.?!;]*)*$")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+")
#: Words of sentences that explain a notice at length.
_TOPIC = re.compile(r"\b(?:java ?scripts?|scripts?|scripting|cookies?|ad ?blockers?|browsers?|reload|refresh)\b")


def _kind(line: str) -> int:
    return 2 if residue_line(line) else 1 if NEUTRAL.match(line) else 0


class Reading:
    """The masked lines ``lo`` to ``hi`` of a text without a title and footer, ``aside``; kinds are worked out when asked for."""

    def __init__(self, text: str):
        self.lines = [m for x in re.split(r"\r\n|\r|\n", _MASK.sub("#", text.lower())) if (m := " ".join(x.split()))]
        self.kinds: dict[int, int] = {}
        self.lo, self.hi, self.aside = 0, len(self.lines), []
        if self.hi > 1 and len(self.lines[0].split()) <= 10 and _TITLE.match(self.lines[0]) and not self.kind(0):
            self.lo, self.aside = 1, [self.lines[0]]
        while self.hi - self.lo > 1:
            end = self.lines[self.hi - 1]
            short = len(end.split()) <= 6 and _TITLE.match(end)
            if not (short or NEUTRAL.match(end)) or (kind := self.kind(self.hi - 1)) == 2:
                break
            self.hi -= 1
            if not kind:  # one line that isn't known as a footer
                self.aside.append(end)
                break

    def kind(self, i: int) -> int:
        """2 residue by rule, 1 neutral, 0 unknown."""
        if i not in self.kinds:
            self.kinds[i] = _kind(self.lines[i])
        return self.kinds[i]

    def sentences(self, i: int) -> list[tuple[str, int]]:
        """Line i, if no rule knows it, in sentences with their kinds. In a line of more than LINE words that opens with a
        notice, sentences that go on about scripts and browsers are neutral."""
        if k := self.kind(i):
            return [(self.lines[i], k)]
        parts = _SENTENCE.split(self.lines[i])
        own = [_kind(x) for x in parts]
        notice = len(self.lines[i].split()) > LINE and own[0] == 2
        return [(x, 1 if notice and not k and _TOPIC.search(x) else k) for x, k in zip(parts, own, strict=True)]

    def segments(self) -> list[tuple[str, int]]:
        return [x for i in range(self.lo, self.hi) for x in self.sentences(i)]

    def longest(self) -> str | None:
        """The longest unknown segment (the first of several); lines that are shorter than one already found aren't judged."""
        best = ""
        for i in sorted(range(self.lo, self.hi), key=lambda i: (-len(self.lines[i]), i)):
            if len(self.lines[i]) <= len(best):
                break
            if self.kind(i):
                continue
            parts = _SENTENCE.split(self.lines[i])
            if len(parts) > 1 and len(self.lines[i].split()) > LINE and _kind(parts[0]) == 2:
                parts = [x for x, k in self.sentences(i) if not k]
            for x in sorted(parts, key=len, reverse=True):
                if len(x) <= len(best):
                    break
                if len(parts) == 1 or not _kind(x):
                    best = x
                    break
        return best or None


# --- SimHash ----------------------------------------------------------------------------------------------------------
def grams(body: str) -> np.ndarray:
    """Distinct runs of GRAM bytes, as numbers."""
    raw = np.frombuffer(body.encode(errors="replace").ljust(GRAM), np.uint8).astype(np.uint32)
    return np.unique(raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24)


def simhash(g: np.ndarray) -> int:
    x = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    votes = np.zeros(64, np.int64)
    for p in range(0, len(x), 8192):
        votes += np.unpackbits(x[p : p + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(x)).view(np.int64)[0])


def _key(segment: str) -> bytes:
    return hashlib.blake2b(segment.encode(errors="replace"), digest_size=16).digest()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a document: mark (placeholder), its longest unknown segment, and for documents that the rules know whole proof
    (some of it is residue) and their residue segments."""
    for b in batches:
        rows: dict[str, list] = {c: [] for c in ("id", "mark", "segment", "proof", "trusted")}
        for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
            read, trusted = Reading(text), []
            if (segment := read.longest()) is None:
                trusted = sorted({x for x, k in read.segments() if k == 2})
                if not trusted:  # neutral lines only: the title or footer has to say it
                    segment = max(read.aside, key=len, default=None)
            for c, x in zip(rows, (i, placeholder(text), segment, bool(trusted), trusted), strict=True):
                rows[c].append(x)
        kinds = (pa.int64(), pa.bool_(), pa.string(), pa.bool_(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, doc, segment, needed, label): the segments of a document but for neutral ones, label 2 if residue by rule. Title
    and footer need no label, but may give one. ``doc`` tells documents that share an id apart."""
    for b in batches:
        rows: dict[str, list] = {c: [] for c in ("id", "doc", "segment", "needed", "label")}
        for i, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
            read, doc = Reading(text), _key(text)
            found = {x: (False, 0) for x in read.aside} | {x: (True, k) for x, k in read.segments() if k != 1}
            for x, (needed, label) in found.items():
                for c, y in zip(rows, (i, doc, x, needed, label), strict=True):
                    rows[c].append(y)
        kinds = (pa.int64(), pa.binary(), pa.string(), pa.bool_(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [grams(x) for x in b.column("segment").to_pylist()]
        keys = [_key(x) for x in b.column("segment").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), b.column("segment"), b.column("label"), pa.array([simhash(g) for g in found], pa.int64()), pa.array([len(g) for g in found], pa.int32())], names=["b", "segment", "label", "sim", "n"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), strict=True):
            g, h = grams(x), grams(y)
            both = len(np.intersect1d(g, h, assume_unique=True))
            keep.append(both >= SIMILAR * (len(g) + len(h) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


class Segments:
    """Nodes (b, segment, label, sim, n, new), b the digest of the segment, of tables of (segment, label)."""

    def __init__(self, df: DataFrame, stage: Stage):
        self.stage, self.grown = stage, False
        self.nodes = stage.put(self._hash(df))

    @staticmethod
    def _hash(df: DataFrame) -> DataFrame:
        once = df.where("segment is not null").groupBy("segment").agg(F.max("label").cast("int").alias("label"))
        return once.mapInArrow(_hashed, "b binary, segment string, label int, sim long, n int").withColumn("new", F.lit(True))

    def add(self, df: DataFrame) -> None:
        """More segments; those that are nodes already stay as they are."""
        more = self._hash(df.join(self.nodes.select("segment"), "segment", "left_anti"))
        self.nodes, self.grown = self.stage.put(self.nodes.withColumn("new", F.lit(False)).union(more)), True

    @staticmethod
    def _tables(df: DataFrame, reach: int) -> DataFrame:
        cut = [i * 64 // PIECES for i in range(PIECES + 1)]
        piece = [F.shiftrightunsigned("sim", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).cast("int") for lo, hi in zip(cut, cut[1:], strict=False)]
        band = F.floor(F.ln("n") / F.lit(-math.log(SIMILAR))).cast("int")  # similar sets are at most one band apart
        keys = [((F.lit(t * 64) + piece[i]) * 64 + piece[j]) * 64 for t, (i, j) in enumerate(combinations(range(PIECES), 2))]
        near = F.explode(F.array(*[F.greatest(band + d, F.lit(0)) for d in range(-reach, reach + 1)]))
        cells = df.select("b", "sim", "n", near.alias("band")).distinct() if reach else df.select("b", "sim", "n", band.alias("band"))
        return cells.select("b", "sim", "n", "band", F.explode(F.array(*keys)).alias("k")).select("b", "sim", "n", (F.col("k") + F.col("band")).alias("k"))

    def similar(self, front: DataFrame, to: DataFrame) -> DataFrame:
        """(a, b): nodes ``b`` of ``to`` that the tables find for nodes ``a`` of ``front``, verified."""
        near = self._tables(to, 0).join(self._tables(front, 1).select(F.col("b").alias("a"), F.col("sim").alias("sa"), F.col("n").alias("na"), "k"), "k")
        near = near.where((F.bit_count(F.col("sim").bitwiseXOR(F.col("sa"))) <= HAMMING) & (F.least("n", "na") >= SIMILAR * F.greatest("n", "na")) & (F.col("a") != F.col("b"))).select("a", "b").distinct()
        both = near.join(front.select(F.col("b").alias("a"), F.col("segment").alias("sa")), "a").join(to.select("b", F.col("segment").alias("sb")), "b")
        return both.select("a", "b", "sa", "sb").mapInArrow(_similar, "a binary, b binary")

    def spread(self) -> DataFrame:
        """Give every node the largest label of its component, from the labelled nodes out; returns ``nodes``.

        In the first round only new nodes can learn anything: the others have met all labels that are older.
        """
        front, reach, old = self.nodes.where("label > 0"), self.nodes.where("new"), self.grown
        while True:
            ends = front.agg(F.min("n"), F.max("n"), F.max("label")).first()
            if ends[0] is None:
                return self.nodes
            may = reach.where(F.col("n").between(SIMILAR * ends[0], ends[1] / SIMILAR) & (F.col("label") < ends[2]))
            found = self.similar(front, may).join(front.select(F.col("b").alias("a"), F.col("label").alias("to")), "a").groupBy("b").agg(F.max("to").alias("to"))
            front, n = self.stage.counted(self.nodes.join(found, "b").where("to > label").select("b", "segment", F.col("to").alias("label"), "sim", "n", "new"))
            if n:
                up = front.select("b", F.col("label").alias("to"))
                self.nodes = self.stage.put(self.nodes.join(up, "b", "left").select("b", "segment", F.coalesce("to", "label").alias("label"), "sim", "n", "new"))
            if old:  # the old nodes haven't met the labels of new ones
                front, old = self.nodes.where("new and label > 0"), False
            elif not n:
                return self.nodes
            reach = self.nodes


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, found_by): kind ``placeholder`` or ``no_content``.

    ``found_by`` is ``rule`` where rules know every segment, ``similar`` where a label came through the tables. Null and
    blank texts are no cases; texts are read whole; every row comes out for itself, rows that share an id if one of
    them is a case; a document with both kinds has one row of kind placeholder. Empty tables give no rows;
    other columns are not read.
    """
    spark, stage = documents.sparkSession, Stage(documents.sparkSession, "residue")
    docs = documents.select(F.col("doc_id").alias("d"), "text").where(r"d is not null and text is not null and text rlike '\\S'")
    docs = spread(docs.select(F.col("d").alias("id"), "text"), "id")
    read = stage.put(docs.mapInArrow(_read, "id long, mark boolean, segment string, proof boolean, trusted array<string>"))
    known = spark.createDataFrame(examples(), "segment string, label int")
    trusted = read.select(F.explode("trusted").alias("segment"), F.lit(2).alias("label"))
    graph = Segments(read.select("segment", F.lit(0).alias("label")).union(trusted).union(known), stage)
    labels = graph.spread().where("label > 0").select("segment", "label")
    # only documents whose longest unknown segment got a label can be without content: their other segments follow
    may = read.where("segment is not null").join(labels, "segment", "left_semi").select("id").distinct()
    more = stage.put(docs.join(may, "id", "left_semi").mapInArrow(_expand, "id long, doc binary, segment string, needed boolean, label int"))
    if not more.isEmpty():
        graph.add(more.select("segment", "label"))
        labels = graph.spread().where("label > 0").select("segment", F.col("label").alias("got"))
        each = more.join(labels, "segment", "left").groupBy("id", "doc").agg(F.min(F.when(F.col("needed"), F.coalesce("got", F.lit(0)))).alias("least"), F.max("got").alias("most"))
        similar = each.where("coalesce(least, 1) > 0 and most = 2").select("id").distinct()
    else:
        similar = may
    out = read.join(similar.withColumn("near", F.lit(True)), "id", "left").where("mark or proof or near")
    return out.select(F.col("id").alias("doc_id"), F.when(F.col("mark"), "placeholder").otherwise("no_content").alias("kind"), F.when(F.col("mark") | F.col("proof"), "rule").otherwise("similar").alias("found_by"))

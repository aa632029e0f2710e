"""Template residue, filler, error pages and script notices in texts.

Texts fall into segments (lines and sentences) of any length.  A segment's
template is what remains when its variable tokens are masked.  Segments descend a
prefix tree of fixed depth (:data:`DEPTH` tokens); a node is judged once, by
whether any message of the rules can begin with its tokens, and what lies below a
node that none can is dropped at once.  The templates left in the leaves are far
fewer than segments; each distinct one is classified once, and the verdict goes
back to all texts that hold it.  Templates are not merged within a leaf, so no
message loses its verdict to others that begin alike.

Unresolved slots occur inside sentences that are otherwise ordinary, so they are
looked for in the text itself.  So is filler in invented words, which has no fixed
wording: it shows in sentences without a single short word (no language has many
of those) that draw on a closed vocabulary, which the share of distinct words tells.

What is quoted is not residue: fenced blocks, inline code and block quotes are
taken out first, and a template counts only as a whole segment, so that a
sentence that mentions an error or a notice is none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.session import cut_lineage, spread

#: Tokens of a segment that lead through the prefix tree.
DEPTH = 6
#: Words of closed-vocabulary sentences from which on a text is judged by them, and the share of distinct words
#: at most: of few words (up to ``FEW_WORDS``) and of many.
LEAST_WORDS, FEW_WORDS = 8, 20
CLOSED_FEW, CLOSED_MANY = 0.85, 0.65

_WILD = "<*>"

# Ways to write a slot that a template engine should have filled (case ignored where marked).
SLOTS = (
    r"\{\{[{#/&]?\s*[\p{L}_][\p{L}\p{N}_.\- ]*\s*\}\}",
    r"(?<![\w/])\$\{\s*[\p{L}_][\p{L}\p{N}_.]*\s*\}",
    r"(?<![\w/])#\{\s*[\p{L}_][\p{L}\p{N}_.]*\s*\}",
    r"<%[=-]?\s*[\p{L}_][^%\n]{0,80}%>",
    r"%\(\s*[\p{L}_][\p{L}\p{N}_.]*\s*\)[sdif]\b",
    r"(?<![\w%])%[A-Z][A-Z0-9_]{2,}%(?![\w%])",
    r"(?<![\w$])\$[A-Z][A-Z0-9_]{2,}\$(?![\w$])",
    r"(?<!\w)__(?!FILE__|LINE__|DEV__)[A-Z][A-Z0-9_]+__(?!\w)",
    r"@@\s*[\p{L}_][\p{L}\p{N}_.]*\s*@@",
    r"\[\[\s*(?i:[a-z]+(?:[_.][a-z_.]+)?)\s*\]\](?!\()",
    r"(?<![\w/$#%{}\"'=\\])\{(?i:[a-z]+(?:[_.][a-z]+)*)\}(?![\w/}\"'])",
    r"<[A-Z][A-Z0-9_]{2,}>",
    r"<(?i:[a-z]+(?: [a-z']+){1,6})>",
    r"(?<![\w\]!])\[(?!CLS\]|SEP\]|PAD\]|UNK\]|MASK\]|INST\])[A-Z][A-Z0-9_]{2,}\](?![(:\[\w])",
    r"(?<![\w\]!])\[(?i:(?:insert|describe|your|enter|add|name of|what you|and so on|first|second|third|next|choose|select|fill|replace|todo|tbd)\b[^\]\n\[]{0,60}|[a-z]+ (?:name|here|title|date|step|e-?mail|address|version|url))\.{0,3}\](?![(:\[])",
)

_JS = r"(?:java ?script|scripts?|scripting|js|cookies)"
_JS_X = r"(?:java ?script|les scripts|des scripts|los scripts|scripts?|skripte|cookies)"

# Whole messages after masking, in lower case and without punctuation, by kind and language.
RULES = {
    "script": (
        rf"(?:please |kindly )?(?:you (?:need|have|must|should)(?: to)? )?(?:enable|activate|allow|turn on|switch on) {_JS}\b(?! the\b).*",
        rf"(?:java ?script|js|scripts and cookies|cookies and scripts|scripts|cookies)(?: (?:is|are|must be|has to be|have to be|needs to be|need to be))? (?:disabled|blocked|required|needed|enabled|allowed|turned off|switched off)(?: (?:in|by|for|to|on) .*| this .*)?",
        r"(?:this|the) (?:site|page|app|application|website|viewer) requires (?:java ?script|cookies)",
        rf"(?:your browser|this browser) (?:does not|doesn't|cannot) (?:support|run|show) .*",
        r"turn (?:them|it) on in your browser(?: settings)?(?: and reload)?",
        r"some features (?:will|may) not work",
        r"(?:we're|we are) checking your browser.*|checking your browser before .*",
        rf"(?:bitte )?(?:aktivieren|erlauben|schalten) sie {_JS_X}\b.*",
        r"bitte im browser (?:einschalten|aktivieren)",
        rf"diese (?:ansicht|seite|anwendung) (?:benötigt|erfordert|braucht) {_JS_X}\b.*",
        rf"(?:java ?script|skripte) (?:ist|sind|muss|müssen) .*",
        rf"(?:vous devez |veuillez )(?:activer|autoriser) (?:le )?{_JS_X}\b.*|activez {_JS_X}\b.*",
        r"les scripts sont (?:bloqués|désactivés)\b.*",
        rf"cette (?:page|application|vue) (?:nécessite|requiert) {_JS_X}\b.*",
        rf"(?:necesita |debe |por favor )?(?:habilitar|habilite|activar|active) {_JS_X}\b.*",
        rf"esta (?:página|aplicación|vista) (?:requiere|necesita) {_JS_X}\b.*",
        r"(?:actívelos|habilítelos) en su navegador",
    ),
    "error": (
        r"(?:http |error |http error )?<\*> (?:not found|bad gateway|forbidden|unauthorized|internal server error|service unavailable|gateway time ?-?out|bad request|too many requests)",
        r"(?:not found|bad gateway|internal server error|service unavailable|gateway time ?-?out|access denied|permission denied|page not found)",
        r"(?:error|fehler|erreur|http error) <\*>(?: .*)?",
        r"error could not (?:fetch|load|open|connect|reach) .*|could not (?:fetch|load|open|reach) <\*>.*",
        r"(?:the|this) (?:requested )?(?:page|url|file|resource)(?: <\*>)? (?:does not exist|doesn't exist|could not be found|was not found|cannot be found|isn't available|is not available|is no longer available)(?: .*)?",
        r"the link may be broken.*",
        r"you (?:do not|don't) have (?:permission|access) to .*",
        r"(?:please )?contact (?:your|the) (?:system )?administrator.*",
        r"your session (?:has )?(?:expired|timed out).*",
        r"please (?:sign|log) in(?: again)?(?: to continue)?",
        r"(?:sorry )?(?:we )?(?:couldn't|could not|can't|cannot) find that .*",
        r"it may be private renamed or deleted",
        r"(?:oops )?something went wrong(?: .*)?|oops",
        r"(?:please )?try again (?:later|in .*)",
        r"rate limit exceeded(?: .*)?|retry after <\*> .*|too many requests(?: .*)?",
        r"(?:the )?(?:service|site|server) (?:is )?(?:temporarily|currently) (?:unavailable|down).*",
        r"(?:we'll|we will) be back (?:shortly|soon).*",
        r"failed to (?:load|fetch|open) (?:the )?(?:document|page|resource|file|content)\b.*",
        r"connection (?:reset by peer|refused|timed out)(?: attempt .*)?",
        r"the (?:answer|response|page) could not be (?:produced|generated|loaded)(?: .*)?",
        r"zugriff verweigert(?: .*)?|bitte melden sie sich(?: erneut)? an",
        r"die (?:angeforderte )?seite (?:wurde nicht gefunden|existiert nicht)|seite nicht gefunden|zurück zur startseite",
        r"der dienst (?:.* )?(?:antwortet nicht|ist nicht (?:verfügbar|erreichbar))|ihre sitzung ist abgelaufen|bitte versuchen sie es später .*|interner serverfehler",
        r"page introuvable(?: <\*>)?|retour à l'accueil|accès refusé(?: .*)?|(?:accès refusé )?votre session a expiré|erreur interne du serveur|veuillez (?:réessayer|vous reconnecter)\b.*|le service est (?:temporairement )?indisponible.*",
        r"acceso denegado(?: .*)?|inicie sesión(?: de nuevo)?|inténtelo (?:más tarde|de nuevo)\b.*|el servicio no está disponible.*|página no encontrada(?: <\*>)?|error interno del servidor|su sesión ha (?:caducado|expirado)",
    ),
    "filler": (
        r"lorem ipsum\b.*",
        r"(?:this is )?(?:placeholder|dummy|sample|filler|example) (?:paragraph|text|copy|content)\b.*",
        r"(?:text ){3,}text(?: .*)?|(?:blah ){2,}blah(?: .*)?|(?:(?:asdf|qwer) ){3,}.*",
        r"some content some content\b.*",
        r"(?:texte provisoire ?)+|(?:texto (?:de relleno|provisional|de ejemplo) ?)+|hier (?:steht|kommt) (?:später|noch|bald) .*text|(?:platzhalter|blind|beispiel)text\b.*",
        r"replace this (?:text|paragraph|section) with .*|say what it does and who should use it",
        r"todo (?:describe|write|add|fill in|explain)\b.*|describe (?:the change|your change) here|how did you test it",
        r"author your name(?: here)?|your name here|title of the document|status draft review final choose one",
        r"item (?:one|two|three)",
        r"hello (?:none|null|undefined|nan)\b.*",
        r"(?:undefined|null|none|nan) .*\b(?:undefined|null|none|nan)\b.*",
    ),
}
# Whole messages that may begin with anything, known by a token they all hold.
MARKED_RULES = {
    "script": (rf"(?:this|the) (?:[\w<*>]+ ){{1,3}}(?:needs|requires|relies on) {_JS} (?:to|in order|and|for) .*",),
    "error": (
        r".* or the page may have been removed",
        r"(?:.* )?<json> (?:error|errors) <json> (?:code|message|status|type)\b.*",
        r"<json> (?:error|code|status|message|errors) .*(?:error|timed out|timeout|denied|not found|unavailable|upstream|failed).*",
        r"(?:.* )?(?:<t> ){3,}(?:<\*>|not found|error|bad gateway|forbidden)(?: <t>| <\*>| [a-z]+)+",
    ),
    "filler": (r".*\bdolor sit amet consectetur\b.*", r".*\bobject object\b.*"),
}
_MARK = re.compile(r"\{\"|</?[A-Za-z]|\b(?:removed|dolor|object|needs|requires|relies)\b", re.I)
_COMPILED = [(kind, re.compile("|".join(f"(?:{r})" for r in (*rules, *MARKED_RULES.get(kind, ()))))) for kind, rules in RULES.items()]
_PREFIX = regex.compile("|".join(f"(?:{r})" for rules in RULES.values() for r in rules))
_REPEATED = re.compile(r"(\w+) (?:\1 ){2,}\1")
_REPEATS = re.compile(r"\W*(\w+)(?:\W+\1){3,}\W*", re.I)


def classify(template: str) -> str | None:
    """Kind of residue a template is, or None."""
    for kind, rule in _COMPILED:
        if rule.fullmatch(template):
            return kind
    return "filler" if _REPEATED.fullmatch(template) else None


def fits(prefix: str) -> bool:
    """Whether a message of ``RULES`` can begin with these tokens."""
    return _PREFIX.fullmatch(prefix, partial=True) is not None


_SPACES = {**dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " "), **dict.fromkeys([0x200B, 0x200C, 0x200D, 0xFEFF], None), 0x2019: "'", 0x85: "\n", 0x2028: "\n", 0x2029: "\n"}
_FENCE = re.compile(r"^[ \t]*(```|~~~)[^\n]*(?:\n.*?(?:^[ \t]*\1[^\n]*$|\Z)|\Z)", re.S | re.M)
_QUOTE = re.compile(r"^[ \t]*>[^\n]*$", re.M)
_CODE = re.compile(r"`[^`\n]*`")
_PIECE = re.compile(r"\n+|(?<=[.!?])\s+|\t+|   +|[\x00-\x08\x0b-\x1f\x7f]+")
#: Where a capitalised word follows something else without a blank, a segment may begin inside a token.
_GLUE = regex.compile(r"(?<=[^\s\p{Lu}\p{Ps}\p{Pi}\"'`/\\._$#@&=+*-])(?=\p{Lu}\p{Ll}+ \p{L})")
_SENTENCE = regex.compile(r"\p{L}\p{Ll}{3,}(?: \p{Ll}{4,}){4,}[.!?]?")
_LEAD = re.compile(r"(?:\s|[#*+\-•]+\s|\d+[.)]\s|\[[ xX]\]\s|<!--)+")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]*>")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
_VARIABLE = re.compile(r"[\\/_\d]|\(\)|[^\W\d_]\.[^\W\d_]|^\W*[a-z]+[A-Z]")
_SLOT = regex.compile("|".join(f"(?:{s})" for s in SLOTS))
#: Distinct tokens whose mask a worker remembers.
_CACHE_SIZE = 100_000


def unquoted(text: str) -> str:
    """The text without fenced blocks and block quotes and with inline code as a wildcard."""
    bare = text if text.isascii() else text.translate(_SPACES)
    if "```" in bare or "~~~" in bare:
        bare = _FENCE.sub("\n", bare)
    if ">" in bare:
        bare = _QUOTE.sub("", bare)
    return _CODE.sub(" \0 ", bare) if "`" in bare else bare


def has_slot(bare: str) -> bool:
    """True if an unresolved slot stands in an unquoted text."""
    return _SLOT.search(bare) is not None


def _mask(token: str) -> tuple[str, ...]:
    if token == "\0":
        return (_WILD,)
    if token == "\1":
        return ("<t>",)
    if '{"' in token:
        return ("<json>", *_WORD.findall(token.lower()))
    words = _WORD.findall(token.lower())
    return (_WILD,) if words and _VARIABLE.search(token) else tuple(words)


def _tokens(piece: str, known: dict[str, tuple[str, ...]]) -> Iterator[str]:
    lead = _LEAD.match(piece)
    if lead:
        piece = piece[lead.end() :]
    if "<" in piece:
        piece = _TAG.sub(" \1 ", piece)
    for token in piece.split():
        words = known.get(token)
        if words is None:
            words = _mask(token)
            if len(known) < _CACHE_SIZE:
                known[token] = words
        yield from words


def masked(piece: str, known: dict[str, tuple[str, ...]]) -> list[str]:
    """Tokens of a segment in lower case; variable ones are a wildcard, punctuation is gone."""
    return list(_tokens(piece, known))


def descend(piece: str, known: dict[str, tuple[str, ...]], nodes: dict[str, bool]) -> str | None:
    """The template of a segment whose leaf some rule reaches, else None.

    ``nodes`` remembers the verdicts of the nodes; tokens below a dead node are
    not even masked.
    """
    tokens = _tokens(piece, known)
    path: list[str] = []
    for token in tokens:
        path.append(token)
        node = " ".join(path)
        live = nodes.get(node)
        if live is None:
            live = fits(node)
            if len(nodes) < _CACHE_SIZE:
                nodes[node] = live
        if not live:
            return None
        if len(path) == DEPTH:
            break
    path += tokens
    return " ".join(path) or None


def closed_vocabulary(pieces: Iterable[str]) -> bool:
    """Whether the sentences without short words repeat themselves as only invented text does."""
    words = [w for piece in pieces if _SENTENCE.fullmatch(piece) for w in piece.rstrip(".!?").lower().split()]
    return len(words) >= LEAST_WORDS and len(set(words)) <= (CLOSED_FEW if len(words) <= FEW_WORDS else CLOSED_MANY) * len(words)


def templates_of(bare: str, known: dict[str, tuple[str, ...]], nodes: dict[str, bool]) -> tuple[set[str], list[str]]:
    """Templates of an unquoted text that a rule may fit, and all its segments."""
    pieces = [p.strip() for p in _PIECE.split(bare) if len(p) >= 3]
    marked = _MARK.search(bare) is not None
    found = set()
    for piece in dict.fromkeys(pieces):
        for at in (0, *(m.start() for m in _GLUE.finditer(piece))):
            part = piece[at:]
            if marked and _MARK.search(part) or _REPEATS.fullmatch(part):
                template = " ".join(_tokens(part, known))
            else:
                template = descend(part, known, nodes)
            if template:
                found.add(template)
    return found, pieces


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates of each text that a rule may fit; verdicts on the text itself stand as its kind."""
    known: dict[str, tuple[str, ...]] = {}
    nodes: dict[str, bool] = {}
    for batch in batches:
        rows: list[tuple] = []
        for document, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            bare = unquoted(text)
            found, pieces = templates_of(bare, known, nodes)
            rows += [(document, template, None) for template in found]
            if has_slot(bare):
                rows.append((document, None, "slot"))
            if closed_vocabulary(pieces):
                rows.append((document, None, "filler"))
        cells = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = (batch.schema.field("doc_id").type, pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["doc_id", "template", "kind"])


def _verdicts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        part = part.assign(verdict=[classify(t) for t in part["template"]])
        yield part[part["verdict"].notna()][["template", "verdict"]]


def residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, kind)`` for texts with residue; kind is script, error, filler or slot.

    Null, empty and blank texts have none.  A text with several kinds has a row
    for each; repeated texts are judged alike.  Whole texts and segments of any
    length are read, once.
    """
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).where(F.length(F.trim("text")) > 0)
    key = texts.schema["doc_id"].dataType.simpleString()
    found = cut_lineage(spread(texts).mapInArrow(_templates, f"doc_id {key}, template string, kind string"))
    verdicts = found.where("template is not null").select("template").distinct().mapInPandas(_verdicts, "template string, verdict string")
    told = found.where("template is not null").join(verdicts, "template").select("doc_id", F.col("verdict").alias("kind"))
    return told.unionByName(found.where("kind is not null").select("doc_id", "kind")).distinct()

"""Template residue, filler, error pages and script notices in records.

Two detectors. Unresolved slots and what failed fills leave behind are found inside ordinary records by
pattern. Messages that stand instead of content are found by their templates: all messages of all fields are
mined with a fixed-depth prefix tree (length, then the first tokens), each template is classified once, by its
constant words and by what mining tells of it, and its verdict is propagated to all its messages. A field is
residue if it holds filler, or if it holds an error message or a script notice and no content beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small, stored
from . import message_classifier
from .message_classifier import KINDS, Classifier

# Words that name slots; between weak delimiters only these, and compounds, make a slot.
SLOT_WORDS = (
    "name title heading product item model brand sku storage ram colour color variant price description category "
    "condition warranty region url image code size text label page content headline site shop store value key id goods prod desc"
).split()
# What a failed fill prints.
EMPTY_WORDS = "null undefined nan none nil".split()
#: Tokens of a message's beginning that the tree branches on, after the length; a leaf that more distinct messages
#: share branches on as many again, so no leaf grows with the corpus.
DEPTH, DEEPER, FULL = 3, 3, 20_000
#: Share of equal tokens at which a message joins a template.
ALIKE = 0.6
#: Messages of a template, the first by order, whose varying words are looked at.
SHOWN = 8
#: A template is no content where the probability of content is below this.
CONTENT = 0.3
#: Below this, words of filler count within a field that has content as well.
SURE = 0.05
#: How often a page that is nothing but an error is flagged as one (by status, say), the pages and hosts that must
#: have shown a template before flags count, and the most that flags may add to a template's log odds.
FLAGGED, WITNESSES, MOST_ODDS = 0.75, 3, 4.0

_WORD = "|".join(SLOT_WORDS)
_NAME = rf"(?:(?:[A-Za-z]\w*[_.\-])+[A-Za-z0-9]+|[a-z]+[A-Z]\w*|(?i:(?:{_WORD})+)|(?i:[\w ]{{2,30}} here))"


def _within(opening: str, closing: str) -> str:
    """Any run that holds a letter or _ between two delimiters."""
    return rf"{opening}(?:(?!{closing})[^\p{{L}}_])*+(?!{closing})[\p{{L}}_](?:(?!{closing}).)*+{closing}"


#: Slots: any run between strong delimiters, slot names between weak ones.
SLOTS = "|".join(
    [
        _within(r"\{\{", r"\}\}"), _within(r"[$#]\{", r"\}"), _within("<%", "%>"), _within(r"\{%", r"%\}"), _within(r"\[\[", r"\]\]"), _within("<<", ">>"), r"@@[\p{L}_][\p{L}\p{M}\p{N}_.\-]*@@", r"(?<![\p{L}\p{N}])__\p{L}[\p{L}\p{M}\p{N}_.\-]*?__(?![\p{L}\p{N}])",
        rf"(?<![\w{{$#])\{{\s?(?:{_NAME}|\d{{1,2}})\s?\}}(?![\w}}])", rf"(?<![\w%])%{_NAME}%(?![\w%])", rf"(?<![\w~])~{_NAME}~(?![\w~])", rf"(?<![\w$])\$(?:{_NAME})\$(?![\w$])", rf"(?<![\w:]):{_NAME}:(?![\w:])", rf"(?<![\w\[])\[{_NAME}\](?![\w\]])",
        rf"(?<![\w<])<(?!/)(?:{_NAME})>(?![\w>])",
    ]
)
#: Marks of failed fills that are no words.
FAILED = r"\[object Object\]|#(?:REF|VALUE|NAME\?|DIV/0|N/A|NULL|NUM)!?(?=\W|$)|\((?i:null|none|undefined|nan)\)"
_EMPTY = "|".join(EMPTY_WORDS)
#: A field of nothing but empty values and units, or one with two of them.
EMPTY = rf"(?i)^[\s\W]*(?:(?:{_EMPTY})(?:[\s\W]+|$)|\d+\s?(?:gb|tb|mb)\b[\s\W]*)*(?<![a-z])(?:{_EMPTY})(?![a-z])(?:[\s\W]*(?:(?:{_EMPTY})\b|\d*\s?(?:gb|tb|mb|lkr|rs)\b))*[\s\W]*$|(?i)\b({_EMPTY})\s+(?:\1)\b"

#: Marks that any slot has, and words that any empty value has: looked for first, since most texts have none.
_MARKED = r"[{}<>%$~@\[]|__|:[A-Za-z]"
_EMPTIES = rf"(?i)\b(?:{_EMPTY})\b"


#: Tokens are words and separators that stand alone; separators do not count for how much messages have in common.
_TOKENS = r"[\p{L}\p{M}\p{N}#]+(?:['’\-/.][\p{L}\p{M}\p{N}#]+)*|(?<!\S)[|–-](?!\S)"
_SIGNS = frozenset("|–-")


class PrefixTree:
    """The templates of messages that begin alike; those of one tree have one length.

    A message joins the template with which it has most tokens in common, ``alike`` of them at least, if no word
    that the classifier knows differs; where they differ the template varies from then on. Candidates are found
    by the tokens they must share, so a full leaf is not searched from end to end.
    """

    def __init__(self, telling=lambda word: False, alike: float = ALIKE):
        self.telling, self.alike = telling, alike
        self.templates: list[list[str]] = []
        self._at: dict[tuple[int, str], list[int]] = {}

    def place(self, tokens: list[str]) -> int:
        """The number of the template that a message joins or founds."""
        words = [k for k, t in enumerate(tokens) if t not in _SIGNS]
        needed = max(1, int(np.ceil(self.alike * len(words) - 1e-9)))
        lists = sorted((self._at.get((k, tokens[k]), ()) for k in words), key=len)
        best, most = -1, needed - 1
        # Whoever shares that many words shares one of any words - needed + 1 of them: the rarest are looked at.
        for number in sorted({n for found in lists[: len(words) - needed + 1] for n in found}):
            template, same = self.templates[number], 0
            for a, b in zip(template, tokens, strict=True):
                if a == b:
                    same += b not in _SIGNS
                elif self.telling(b) or (a != "<*>" and self.telling(a)):
                    same = -1
                    break
            if same > most:
                best, most = number, same
        if best < 0:
            self.templates.append(list(tokens))
            for k, t in enumerate(tokens):
                self._at.setdefault((k, t), []).append(len(self.templates) - 1)
            return len(self.templates) - 1
        template = self.templates[best]
        for k, (a, b) in enumerate(zip(template, tokens, strict=True)):
            if a != b and a != "<*>":
                self._at[k, a].remove(best)
                template[k] = "<*>"
        return best


def odds_of_flags(flagged: int, judged: int, hosts: bool, usual: float) -> float:
    """What a template's flags add to its log odds of being no content: 0 for few pages, or pages of one host.

    Nothing is taken away: pages of filler are flagged by nobody.
    """
    if judged < WITNESSES or not hosts or not 0 < usual < FLAGGED:
        return 0.0
    odds = flagged * np.log(FLAGGED / usual) + (judged - flagged) * np.log((1 - FLAGGED) / (1 - usual))
    return float(np.clip(odds, 0.0, MOST_ODDS))


def verdict(model: Classifier, template: str, odds: float = 0.0, messages: list[str] = ()) -> tuple[str, float]:
    """(kind, probability of content) of a template, <*> standing for what varies; ``odds`` is what mining adds.

    Its constant words weigh as much as all words of some of its ``messages``, so what varies counts half: names
    in an error's message do not make it content, and content of one build stays content. The words of an error
    also stand with a name of up to three words after a separator, such as a shop's.
    """

    def judged(text: str) -> tuple[str, float]:
        scores = model.scores(text)
        if "<*>" in text and messages:
            scores = (scores + sum(map(model.scores, messages)) / len(messages)) / 2
        rest = np.logaddexp.reduce(scores[1:])
        content = 1 / (1 + np.exp(np.clip(rest - scores[0] + odds, -700, 700)))
        if content >= CONTENT or not model.can_tell(text):
            return "content", float(content)
        return KINDS[1 + int(scores[1:].argmax())], float(content)

    kind, content = judged(template)
    if kind == "content":
        head, sign, tail = re.sub(r"\s+", " ", template).rpartition(" | ")
        if not sign:
            head, sign, tail = re.sub(r"\s+", " ", template).rpartition(" - ")
        if sign and 0 < len(message_classifier.words_of(tail)) <= 3 and "#" not in tail:
            before = judged(head)
            kind, content = before if before[0] in ("error", "notice") else (kind, content)
    return kind, content


def _mine(model, usual: float):
    """Rows (leaf, key, message, tokens, ...) sorted by leaf -> a row for each message and, as a leaf ends, for each template."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, here, sums = None, None, []
        out: list[list] = [[] for _ in range(6)]

        def close() -> None:
            for number, (template, (n, flagged, judged, low, high, some)) in enumerate(zip(tree.templates if tree else [], sums, strict=True)):
                said = " ".join(template)
                odds = odds_of_flags(flagged, judged, low != high, usual)
                kind, content = verdict(model.value, said, odds, some)
                for column, value in zip(out, (None, f"{here} {number}", said, kind, content, n), strict=True):
                    column.append(value)

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()), pa.array(out[4], pa.float64()), pa.array(out[5], pa.int64())],
                names=["message", "template_id", "template", "verdict", "content", "records"],
            )
            for column in out:
                column.clear()
            return batch

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("leaf", "message", "tokens", "n", "flagged", "judged", "low", "high")]
            for leaf, message, tokens, n, flagged, judged, low, high in zip(*columns, strict=True):
                if leaf != here:
                    close()
                    tree, here, sums = PrefixTree(model.value.telling), leaf, []
                number = tree.place(tokens)
                if number == len(sums):
                    sums.append([0, 0, 0, low, high, []])
                total = sums[number]
                total[0], total[1], total[2] = total[0] + n, total[1] + flagged, total[2] + judged
                if len(total[5]) < SHOWN:
                    total[5].append(message)
                if low is not None:
                    total[3], total[4] = (low, high) if total[3] is None else (min(total[3], low), max(total[4], high))
                for column, value in zip(out, (message, f"{leaf} {number}", None, None, None, n), strict=True):
                    column.append(value)
            yield rows()
        close()
        yield rows()

    return run


def classifier_of(messages: DataFrame) -> Classifier:
    """The classifier for a corpus of messages (message, leaf, n, flagged, judged): fitted to the examples and a bounded pool.

    Half of the pool are two messages of each leaf that most records have, half are taken by hash. Messages that
    mostly flagged pages show are kept out of it, since it stands for content.
    """
    half, usable = message_classifier.POOL // 2, messages.where("flagged * 2 <= judged")
    leaves = usable.groupBy("leaf").agg(F.sum("n").alias("n"), F.min("message").alias("a"), F.max("message").alias("b")).where("a < b")
    alike = leaves.orderBy(F.desc("n"), "leaf").limit(half // 2).select("a", "b").collect()
    drawn = usable.select("message").orderBy(F.xxhash64("message"), "message").limit(half).collect()
    return message_classifier.fit([r[0] for r in drawn], [tuple(r) for r in alike])


def mined(messages: DataFrame) -> DataFrame:
    """(message, template_id) of each message and (template_id, template, verdict, content, records) of each template.

    ``messages`` has (message, n, flagged, judged, low, high): each masked message once, the records that have it,
    how many of those that show nothing else are flagged as errors, how many could be, and the least and the
    greatest host. Rows of messages have a null verdict, rows of templates a null message. Only words that every
    message of a template has count for its verdict, and so do its flags, if several hosts show it.
    """
    leaf = lambda depth: F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))
    first = messages.select("*", F.regexp_extract_all("message", F.lit(_TOKENS), F.lit(0)).alias("tokens")).withColumn("leaf", leaf(DEPTH))
    usual = messages.agg(F.sum("flagged"), F.sum("judged")).first()
    usual = (usual[0] or 0) / usual[1] if usual[1] else 0.0
    model = messages.sparkSession.sparkContext.broadcast(classifier_of(first))
    full = first.groupBy("leaf").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > FULL).select("leaf", F.lit(True).alias("full"))
    placed = first.join(small(full), "leaf", "left").withColumn("leaf", F.when(F.col("full"), leaf(DEPTH + DEEPER)).otherwise(F.col("leaf")))
    rows = placed.select("leaf", "message", "tokens", "n", "flagged", "judged", "low", "high").repartition("leaf").sortWithinPartitions("leaf", "message")
    return rows.mapInArrow(_mine(model, usual), "message string, template_id string, template string, verdict string, content double, records bigint")


def _letters(col: Column) -> Column:
    return F.regexp_replace(F.lower(col), r"[^\p{L}\p{N}]+", "")


def _without_shop(message: Column, host: Column) -> Column:
    """A message without the shop's name at its end; the name is told by the host of the record's address."""
    out = message
    for words in (3, 2, 1):
        tail = F.regexp_extract(message, rf"((?:^|[\s|–-]+)(?:[\p{{L}}\p{{N}}().]+\s+){{{words - 1}}}[\p{{L}}\p{{N}}().]+)[\s.]*$", 1)
        name = F.regexp_replace(_letters(tail), "pvtltd$", "")
        out = F.when((F.length(name) >= 4) & host.startswith(name), F.substring(message, F.lit(1), F.greatest(F.lit(0), F.length(F.rtrim(message)) - F.length(tail)))).otherwise(out)
    # Most messages end with no word of the host's name.
    last = _letters(F.substring_index(F.rtrim(F.translate(message, ".\t\u00a0", " ")), " ", -1))
    return F.when(F.coalesce(host.contains(last) | last.isin("pvtltd", "ltd"), F.lit(False)), out).otherwise(message)


def _masked(message: Column) -> Column:
    """A message in lower case, without tags and entities, # for numbers and hexadecimal ids, one blank between words."""
    bare = F.when(message.contains("<") | message.contains("&"), F.regexp_replace(message, r"<[^<>]{1,200}>|&#?\w{2,8};", " ")).otherwise(message)
    hexed = r"[0-9][0-9a-f]{2,}|[a-f](?:[a-f]+[0-9]|[0-9][0-9a-f])[0-9a-f]*"
    ids = F.regexp_replace(F.lower(bare), rf"(?<![\p{{L}}\p{{N}}])(?:{hexed})(?![\p{{L}}\p{{N}}])|[0-9]+", "#")
    return F.trim(F.regexp_replace(ids, r"(?U)\s{2,}|[^\S ]", " "))


def messages_of(fields: DataFrame) -> DataFrame:
    """(source_table, record_id, field, of, message, host, flagged): each message of a field, masked; ``of`` is their number."""
    # In two steps, so that each is computed once.
    cut = F.transform(F.transform(F.split("text", r"(?<=[.!?])\s+|[\r\n]+"), lambda m: _without_shop(m, F.col("host"))), _masked)
    told = fields.select("source_table", "record_id", "field", "host", "flagged", F.filter(cut, lambda m: m.rlike(r"\p{L}")).alias("said"))
    return told.select("source_table", "record_id", "field", "host", "flagged", F.size("said").alias("of"), F.explode("said").alias("message"))


def residue(fields: DataFrame) -> DataFrame:
    """(source_table, record_id, field, kind) of the fields (source_table, record_id, field, text, host) that are residue.

    kind is 'slot', 'failed fill', 'filler' or 'error'. Null and blank texts are none, and neither are texts
    without letters. Every field is judged by itself, whole. A page_type that merely says error is none. Whether a
    page is flagged as an error may be told by a boolean column ``flagged``, null where nothing tells it; flags
    say nothing about their own page, but a template that flagged pages of several hosts show is suspect. Repeated
    rows have a row each only if they are residue directly; a field named twice for a record is one field.
    """
    named = fields if "flagged" in fields.columns else fields.withColumn("flagged", F.lit(None).cast("boolean"))
    known = named.where("record_id is not null and text is not null")
    text = F.col("text")
    slot, failed = text.rlike(_MARKED) & text.rlike(SLOTS), text.rlike(FAILED) | (text.rlike(_EMPTIES) & text.rlike(EMPTY))
    marked = known.select("source_table", "record_id", "field", "text", "host", "flagged", F.when(slot, "slot").when(failed, "failed fill").alias("kind"))
    direct = marked.where("kind is not null").select("source_table", "record_id", "field", "kind")
    said = stored(messages_of(marked.where("kind is null")))
    # Each message once, with what its records tell; a message that a third of all records have is one row from here on.
    alone = F.col("of") == 1
    one = stored(
        said.groupBy("message").agg(
            F.count(F.lit(1)).alias("n"), F.count_if(alone & F.col("flagged")).alias("flagged"), F.count_if(alone & F.col("flagged").isNotNull()).alias("judged"), F.min("host").alias("low"), F.max("host").alias("high")
        )
    )
    found = stored(mined(one))
    bad = found.where("message is null and verdict <> 'content'").select("template_id", "verdict", "content")
    judged = found.where("message is not null").select("message", "template_id").join(small(bad), "template_id").select("message", "verdict", (F.col("content") < SURE).alias("sure"))
    hits = said.join(small(judged), "message").select("source_table", "record_id", "field", "of", "message", "verdict", "sure")
    # A single word is filler only where it is the whole field.
    plain = F.col("message").rlike(r"[\p{L}\p{M}\p{N}]+[^\p{L}\p{M}\p{N}]+[\p{L}\p{N}]") & F.col("sure")
    stands = ((F.col("verdict") == "error") & (F.col("field") != "page_type")) | (F.col("verdict") == "notice")
    by_field = hits.groupBy("source_table", "record_id", "field").agg(
        F.bool_or((F.col("verdict") == "filler") & plain).alias("within"), F.bool_or(F.col("verdict") == "filler").alias("filler"), F.bool_or(stands).alias("error"), (F.count(F.lit(1)) >= F.max("of")).alias("whole")
    )
    kind = F.when(F.col("within") | (F.col("filler") & F.col("whole")), "filler").when(F.col("error") & F.col("whole"), "error")
    return direct.unionByName(by_field.select("source_table", "record_id", "field", kind.alias("kind")).where("kind is not null"))


def host_letters(url: Column) -> Column:
    """The letters of an address's host without www; '' if it has none."""
    return _letters(F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:www\.)?([^/?#:]*)", 1), F.lit("")))


def fields_of(pages: DataFrame, items: DataFrame) -> DataFrame:
    """The judged fields of page_inspections and scraped_items as rows; pages are flagged by their status and type."""
    flagged = F.coalesce(F.col("http_status") >= 400, F.lit(False)) | F.coalesce(F.lower("page_type").rlike("error|bot|captcha"), F.lit(False))
    told = F.col("http_status").isNotNull() | F.col("page_type").isNotNull()
    page = pages.select(
        F.lit("page_inspections").alias("source_table"), F.col("inspection_id").alias("record_id"), host_letters(F.col("url")).alias("host"), F.when(told, flagged).alias("flagged"),
        F.explode(F.create_map(*(x for c in ("page_type", "page_title", "page_text") for x in (F.lit(c), F.col(c))))).alias("field", "text"),
    )
    item = items.select(
        F.lit("scraped_items").alias("source_table"), F.col("item_id").alias("record_id"), host_letters(F.col("product_url")).alias("host"), F.lit(None).cast("boolean").alias("flagged"), F.lit("raw_title").alias("field"), F.col("raw_title").alias("text")
    )
    return page.unionByName(item)


def found(pages: DataFrame, items: DataFrame) -> DataFrame:
    """(source_table, record_id) of the records with residue in any field, each once."""
    return residue(fields_of(pages, items)).select("source_table", "record_id").distinct()

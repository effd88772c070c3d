"""Chat formatting: a finite-state machine over roles and a declarative template with per-segment loss flags.

Defined results: turns go by turn number, then role, then text (nulls first; repeated rows are turns of their own); a
null text or role is an empty one; a null conv_id is a conversation of its own; roles out of order or unknown do not
drop anything, the conversation is formatted all the same with ``valid`` false and ``bad_turn`` the index of the first
turn that the machine refuses (the number of turns, where a conversation ends in a state that is not final).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, table


@dataclass(frozen=True)
class Template:
    """What stands around each turn. ``{role}`` in ``opening`` is replaced by the escaped role."""

    begin: str
    openings: dict[str, str]
    other_opening: str
    closings: dict[str, str]
    other_closing: str
    control: tuple[str, ...]
    loss_roles: frozenset[str]
    #: state -> role -> next state; "start" is the first one.
    machine: dict[str, dict[str, str]]
    final: frozenset[str]
    escape: str = "\\"
    escaper: re.Pattern = field(init=False, compare=False)
    unescaper: re.Pattern = field(init=False, compare=False)

    def __post_init__(self):
        for a in self.control:
            if len(a) < 2 or a[1] == self.escape or any(a[i:] == b[: len(a) - i] for b in self.control for i in range(1, len(a))):
                raise ValueError(f"control string {a!r} is too short or overlaps another one")
        # One escape character is put in after the first character of a control string, and one more where some are there already.
        object.__setattr__(self, "escaper", re.compile("|".join(f"({re.escape(c[0])})(?={re.escape(self.escape)}*{re.escape(c[1:])})" for c in self.control)))
        object.__setattr__(self, "unescaper", re.compile("|".join(f"({re.escape(c[0])}){re.escape(self.escape)}(?={re.escape(self.escape)}*{re.escape(c[1:])})" for c in self.control)))

    def escaped(self, text: str) -> str:
        return self.escaper.sub(lambda m: m[0] + self.escape, text)

    def unescaped(self, text: str) -> str:
        return self.unescaper.sub(lambda m: m[0][:-1], text)


#: Instruction markup in brackets. Roles without a marker of their own name themselves between [ROLE] and [/ROLE].
BRACKETS = Template(
    begin="<s>",
    openings={"system": "<<SYS>>", "user": "[INST] ", "assistant": "[OUT]"},
    other_opening="[ROLE]{role}[/ROLE]",
    closings={"system": "<</SYS>>", "user": " [/INST]", "assistant": "</s>"},
    other_closing="[END]",
    control=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[OUT]", "[ROLE]", "[/ROLE]", "[END]"),
    loss_roles=frozenset({"assistant"}),
    machine={
        "start": {"system": "told", "user": "asked"},
        "told": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    final=frozenset({"answered"}),
)


def check_roles(roles: list[str], template: Template) -> int | None:
    """Index of the first turn that the machine refuses, the number of turns if it stops too early, None if all is well."""
    state = "start"
    for i, role in enumerate(roles):
        state = template.machine.get(state, {}).get(role)
        if state is None:
            return i
    return None if state in template.final else len(roles)


def segments_of(turns: list[tuple[str, str]], template: Template) -> list[tuple[str, bool]]:
    """(text, loss) in order; joined they are the formatted conversation. Only assistant texts bear loss."""
    out = [(template.begin, False)]
    for role, text in turns:
        opening = template.openings.get(role)
        out.append((template.other_opening.replace("{role}", template.escaped(role)) if opening is None else opening, False))
        out.append((template.escaped(text), role in template.loss_roles))
        out.append((template.closings.get(role, template.other_closing), False))
    return out


def read_back(formatted: str, template: Template) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    if not formatted.startswith(template.begin):
        raise ValueError("the conversation doesn't begin as the template says")
    at, turns = len(template.begin), []
    head, _, tail = template.other_opening.partition("{role}")
    while at < len(formatted):
        role = next((r for r, o in template.openings.items() if formatted.startswith(o, at)), None)
        if role is not None:
            at += len(template.openings[role])
        elif formatted.startswith(head, at):
            end = formatted.index(tail, at)
            role, at = template.unescaped(formatted[at + len(head) : end]), end + len(tail)
        else:
            raise ValueError(f"no turn begins at {at}")
        closing = template.closings.get(role, template.other_closing)
        end = formatted.index(closing, at)
        turns.append((role, template.unescaped(formatted[at:end])))
        at = end + len(closing)
    return turns


FORMATTED = "conv_id long, n_turns long, valid boolean, bad_turn int, segments array<struct<text:string,loss:boolean,role:string>>"


def format_conversations(conversations: DataFrame, template: Template = BRACKETS) -> DataFrame:
    """One row per conversation: whether its turn order is valid, and its text segments with loss flags.

    A conversation is one training example: its turns meet in one task by their nature, other conversations do not.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(turns)

    def formatted(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, got in rows:
            said = [(t["role"] or "", t["text"] or "") for t in got]
            bad = check_roles([r for r, _ in said], template)
            roles = [None, *(role for role, _ in said for _ in range(3))]
            parts = [{"text": s, "loss": loss, "role": r} for (s, loss), r in zip(segments_of(said, template), roles, strict=True)]
            yield conv_id, len(said), bad is None, bad, parts

    return map_rows(grouped, formatted, FORMATTED)


def conversation_digests(formatted: DataFrame, template: Template = BRACKETS) -> DataFrame:
    """Digests that are read back from the formatted output: the turns by the template, the loss text by the flags."""

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, valid, segments in rows:
            whole = "".join(s["text"] for s in segments)
            turns = read_back(whole, template)
            told = "".join(f"{role}\n{text}\n" for role, text in turns)
            loss = "".join(template.unescaped(s["text"]) for s in segments if s["loss"])
            yield conv_id, len(turns), _sha256(told), len(loss), _sha256(loss), len(whole), valid

    return map_rows(
        formatted.select("conv_id", "valid", "segments"),
        digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean",
    )


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op3_chat(spark, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return conversation_digests(format_conversations(said.unionByName(extra)))


#: Turn order as a pattern over role initials; escapes add one character for each control string, escaped ones included.
OP3_SQL = r"""
WITH said AS (
  SELECT conv_id, turn::BIGINT AS turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
filled AS (SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM said),
sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?(?:INST|ROLE)\]|<\\*<SYS>>|<\\*</SYS>>|\[\\*(?:OUT|END)\]'))
    + CASE role WHEN 'system' THEN 7 + 8 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 5 + 4 ELSE 6 + 7 + length(role) + 5 END AS chars,
    CASE role WHEN 'system' THEN 'S' WHEN 'user' THEN 'U' WHEN 'assistant' THEN 'A' ELSE 'X' END AS initial
  FROM filled)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, t NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(chars))::BIGINT AS formatted_chars,
  regexp_full_match(string_agg(initial, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST), 'S?(UA)+') AS valid
FROM sized GROUP BY conv_id
"""

"""Chat formatting: a finite-state machine over roles, and a declarative template.

``format_chats`` writes each conversation as segments of text with a loss flag. The template
gives, per role, a header and a footer and whether the role's text bears loss. A machine over
the roles says whether the turns come in a valid order; invalid conversations are formatted
too and carry ``valid = false`` from the turn that broke the order on.

Control strings inside texts, and the escape sign itself, are escaped reversibly, so the
formatted text can always be read back (``Reader``), whatever the texts hold.

A conversation is read as a sorted stream: state is one small machine, so a conversation may
hold any share of all rows. Order: turn (nulls first), then role, then text.

Cases: null text is empty; a null role is the empty role; null conversation ids form one
conversation; repeated turns are kept; unknown roles are spelled out behind a mark; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    #: role -> (label, whether its text bears loss)
    roles: dict = field(default_factory=lambda: {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True), "tool": ("Tool", False)})
    header: str = "### "
    after_role: str = ": "
    footer: str = " </turn>\n"
    escape: str = "\\"
    #: control string -> the letter that stands for it behind the escape sign
    controls: tuple = (("###", "h"), ("</turn>", "t"))
    #: marks a role that has no label
    unknown: str = "?"
    #: state -> {role: next state}; any other role leads to "broken"
    machine: dict = field(
        default_factory=lambda: {
            "start": {"system": "system", "user": "user"},
            "system": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user", "tool": "tool"},
            "tool": {"assistant": "assistant", "tool": "tool"},
        }
    )

    def escaped(self, column):
        """The text with control strings escaped, as a built-in expression."""
        out = F.replace(column, F.lit(self.escape), F.lit(self.escape * 2))
        for text, letter in self.controls:
            out = F.replace(out, F.lit(text), F.lit(self.escape + letter))
        return out

    def role_label(self, role):
        """Labels of known roles; other roles escaped behind the mark. Colons are escaped too, for they end a label."""
        own = F.concat(F.lit(self.unknown), F.replace(self.escaped(role), F.lit(":"), F.lit(self.escape + "c")))
        out = own
        for name, (label, _) in self.roles.items():
            out = F.when(role == name, F.lit(label)).otherwise(out)
        return out


SEGMENTS = "conv_id long, segment long, text string, loss boolean, turn_start boolean, valid boolean"


def format_chats(turns: DataFrame, template: Template | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Segments (conv_id, segment, text, loss, turn_start, valid); rows of one conversation lie in one partition, in order."""
    t = template or Template()
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Escaping is per turn, so it is done where the rows lie, before they move.
    rows = rows.select("conv_id", "turn", "role", "text", F.concat(F.lit(t.header), t.role_label(F.col("role")), F.lit(t.after_role)).alias("head"), t.escaped(F.col("text")).alias("body"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").select("conv_id", "role", "head", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_id, state, n, first = None, "start", 0, True
        for b in batches:
            out: list[tuple] = []
            for c, r, head, body in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if first or c != conv_id:
                    conv_id, state, n, first = c, "start", 0, False
                state = t.machine.get(state, {}).get(r, "broken")
                valid = state != "broken"
                loss = t.roles.get(r, ("", False))[1]
                out += [(c, n, head, False, True, valid), (c, n + 1, body, loss, False, valid), (c, n + 2, t.footer, False, False, valid)]
                n += 3
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()), strict=True)], names=["conv_id", "segment", "text", "loss", "turn_start", "valid"])

    return rows.mapInArrow(run, SEGMENTS)


class Reader:
    """Reads formatted text back, a chunk at a time: chunks may end anywhere."""

    def __init__(self, t: Template):
        self.t = t
        self.labels = {label: name for name, (label, _) in t.roles.items()}
        self.back = {t.escape: t.escape, "c": ":"} | {letter: text for text, letter in t.controls}
        self.buffer = ""

    def plain(self, text: str) -> str:
        parts = text.split(self.t.escape)
        out, i = [parts[0]], 1
        while i < len(parts):
            if parts[i]:
                out += [self.back[parts[i][0]], parts[i][1:]]
                i += 1
            else:  # a doubled escape sign
                out += [self.t.escape, parts[i + 1] if i + 1 < len(parts) else ""]
                i += 2
        return "".join(out)

    def feed(self, chunk: str) -> Iterator[tuple[str, str]]:
        """(role, text) of every turn that is complete by now."""
        t = self.t
        self.buffer += chunk
        while (end := self.buffer.find(t.footer)) >= 0:
            turn, self.buffer = self.buffer[:end], self.buffer[end + len(t.footer) :]
            if not turn.startswith(t.header):
                raise ValueError("a turn without a header")
            label, _, body = turn[len(t.header) :].partition(t.after_role)
            role = self.plain(label[len(t.unknown) :]) if label.startswith(t.unknown) else self.labels[label]
            yield role, self.plain(body)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def digest(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation, read back from the formatted text and its loss mask; needs the order format_chats leaves."""
    t = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        names = [x.split()[0] for x in DIGEST.split(", ")]

        def row() -> tuple:
            if held["reader"].buffer:
                raise ValueError("formatted text left over")
            return (held["conv"], held["turns"], held["all"].hexdigest(), held["loss_chars"], held["loss"].hexdigest(), held["chars"], held["valid"])

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for b in batches:
            rows = []
            for c, text, loss, valid in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("conv_id", "text", "loss", "valid")), strict=True):
                if held is None or held["conv"] != c:
                    if held is not None:
                        rows.append(row())
                    held = {"conv": c, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "valid": True, "reader": Reader(t)}
                held["chars"] += len(text)
                held["valid"] &= valid
                if loss:
                    plain = held["reader"].plain(text)
                    held["loss"].update(plain.encode())
                    held["loss_chars"] += len(plain)
                for role, said in held["reader"].feed(text):
                    held["turns"] += 1
                    held["all"].update(f"{role}\n{said}\n".encode())
            yield batch(rows)
        if held is not None:
            yield batch([row()])

    return segments.mapInArrow(run, DIGEST)

"""Conversations: arrays of messages with a role and a content."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import strip


@dataclass(frozen=True)
class MessageConfig:
    role_field: str = "role"
    content_field: str = "content"
    user_role: str = "user"
    assistant_role: str = "assistant"
    system_role: str = "system"

    @classmethod
    def of(cls, config: MessageConfig | Mapping[str, str]) -> MessageConfig:
        return config if isinstance(config, MessageConfig) else cls(**config)

    def roles(self) -> tuple[str, str, str]:
        return self.user_role, self.assistant_role, self.system_role


OPENAI = MessageConfig()
SHAREGPT = MessageConfig("from", "value", "human", "gpt", "system")


def from_dicts(df: DataFrame, column: str, config: MessageConfig | Mapping = SHAREGPT, output: str | None = None, to: MessageConfig | Mapping = OPENAI, metadata: Sequence[str] = ()) -> DataFrame:
    """Messages of one layout in another, with chosen fields gathered in ``metadata``; a role that is none of the three is null."""
    a, b = MessageConfig.of(config), MessageConfig.of(to)

    def one(m: Column) -> Column:
        role = F.lit(None).cast("string")
        for old, new in zip(a.roles(), b.roles()):
            role = F.when(m[a.role_field] == old, F.lit(new)).otherwise(role)
        parts = [role.alias(b.role_field), m[a.content_field].alias(b.content_field)]
        if metadata:
            parts.append(F.struct(*[m[f].alias(f) for f in metadata]).alias("metadata"))
        return F.struct(*parts)

    return df.withColumn(output or column, F.transform(F.col(column), one))


def from_string(df: DataFrame, column: str, user: str, assistant: str, system: str, output: str | None = None, to: MessageConfig | Mapping = OPENAI, strip_whitespace: bool = True, replace_values: Mapping[str, str] | None = None) -> DataFrame:
    """Messages of a transcript with literal delimiters; text before the first one is dropped, none gives an empty array."""
    b = MessageConfig.of(to)
    names = {user: b.user_role, assistant: b.assistant_role, system: b.system_role}
    alternatives = "|".join(re.escape(d) for d in sorted(names, key=len, reverse=True))
    pattern = f"(?s)({alternatives})(.*?)(?=(?:{alternatives})|\\z)"
    text = F.col(column)
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("d"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("c"))
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def one(m: Column) -> Column:
        content = m["c"]
        for old, new in (replace_values or {}).items():
            content = F.replace(content, F.lit(old), F.lit(new))
        content = strip(content) if strip_whitespace else content
        return F.struct(F.element_at(table, m["d"]).alias(b.role_field), content.alias(b.content_field))

    return df.withColumn(output or column, F.transform(found, one))


def to_string(df: DataFrame, column: str, user: str, assistant: str, system: str, output: str, config: MessageConfig | Mapping = OPENAI, strip_whitespace: bool = True) -> DataFrame:
    """Delimiter and content of every message in a row; an unknown role is written ``unknown``, null contents are empty."""
    a = MessageConfig.of(config)

    def one(m: Column) -> Column:
        mark = F.lit("unknown")
        for role, delimiter in zip(a.roles(), (user, assistant, system)):
            mark = F.when(m[a.role_field] == role, F.lit(delimiter)).otherwise(mark)
        return F.concat(mark, F.coalesce(m[a.content_field], F.lit("")))

    text = F.array_join(F.transform(F.col(column), one), "")
    return df.withColumn(output, strip(text) if strip_whitespace else text)


def with_length(df: DataFrame, column: str, output: str) -> DataFrame:
    return df.withColumn(output, F.when(F.col(column).isNotNull(), F.size(column)).cast("bigint"))


def with_speakers(df: DataFrame, column: str, config: MessageConfig | Mapping = OPENAI, output: str = "__speakers") -> DataFrame:
    a = MessageConfig.of(config)
    return df.withColumn(output, F.transform(F.col(column), lambda m: m[a.role_field]))


def with_alternating(df: DataFrame, column: str, config: MessageConfig | Mapping = OPENAI, output: str = "__alternating") -> DataFrame:
    """Whether no two neighbours have the same role (two nulls are the same); true for one message or none."""
    a = MessageConfig.of(config)
    c = F.col(column)
    pairs = F.sequence(F.lit(1), F.size(c) - 1)
    same = lambda i: F.element_at(c, i)[a.role_field].eqNullSafe(F.element_at(c, i + 1)[a.role_field])
    return df.withColumn(output, F.when(c.isNull(), F.lit(None)).when(F.size(c) < 2, F.lit(True)).otherwise(F.forall(pairs, lambda i: ~same(i))))


def with_last_speaker(df: DataFrame, column: str, config: MessageConfig | Mapping = OPENAI, output: str = "__last_speaker") -> DataFrame:
    """The role of the last message; null for an empty conversation."""
    return df.withColumn(output, F.try_element_at(F.col(column), F.lit(-1))[MessageConfig.of(config).role_field])


def standardize_last_turn(df: DataFrame, column: str, role: str, config: MessageConfig | Mapping = OPENAI, output: str | None = None) -> DataFrame:
    """Without the messages after the last one of ``role``; empty if there is none."""
    a = MessageConfig.of(config)
    c = F.col(column)
    last = F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(F.size(c), F.lit(1))), lambda i: F.coalesce(F.try_element_at(c, i)[a.role_field] == role, F.lit(False))))
    return df.withColumn(output or column, F.when(c.isNotNull(), F.slice(c, 1, F.coalesce(last, F.lit(0)))))


def add_initial_system_message(df: DataFrame, column: str, message: str, config: MessageConfig | Mapping = OPENAI, output: str | None = None) -> DataFrame:
    a = MessageConfig.of(config)
    fields = df.schema[column].dataType.elementType.fields
    values = {a.role_field: F.lit(a.system_role), a.content_field: F.lit(message)}
    first = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
    return df.withColumn(output or column, F.concat(F.array(first), F.col(column)))


def _taken(message: Column, content_field: str, kind: str) -> Column:
    if kind not in ("string", "dict"):
        raise ValueError("output_type must be string or dict")
    return message[content_field] if kind == "string" else message


def take_initial_system_message(df: DataFrame, column: str, output: str, config: MessageConfig | Mapping = OPENAI, output_type: str = "string", remove: bool = True) -> DataFrame:
    """A system message at the start moved to a column of its own, which is null where there is none."""
    a = MessageConfig.of(config)
    c = F.col(column)
    first = F.try_element_at(c, F.lit(1))
    has = F.coalesce(first[a.role_field] == a.system_role, F.lit(False))
    columns = {output: F.when(has, _taken(first, a.content_field, output_type))}
    if remove:
        columns[column] = F.when(has, F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))).otherwise(c)
    return df.withColumns(columns)


def take_last_message(df: DataFrame, column: str, output: str, config: MessageConfig | Mapping = OPENAI, output_type: str = "string", remove: bool = True) -> DataFrame:
    c = F.col(column)
    columns = {output: _taken(F.try_element_at(c, F.lit(-1)), MessageConfig.of(config).content_field, output_type)}
    if remove:
        columns[column] = F.when(c.isNotNull(), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))))
    return df.withColumns(columns)

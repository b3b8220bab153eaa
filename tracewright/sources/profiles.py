"""What each family of audit logs looks like: one table of patterns and rules for all extractors."""

from __future__ import annotations

from dataclasses import dataclass

#: The considered event types.
CONSIDERED = (
    "EVENT_READ", "EVENT_RECVMSG", "EVENT_WRITE", "EVENT_SENDMSG", "EVENT_FORK", "EVENT_CLONE", "EVENT_EXECUTE", "EVENT_CONNECT",
    "EVENT_UNLINK", "EVENT_RENAME", "EVENT_CREATE_OBJECT", "EVENT_MODIFY_FILE_ATTRIBUTES", "EVENT_LOADLIBRARY", "EVENT_OPEN", "EVENT_MMAP",
)
CONSIDERED_WIDE = (*CONSIDERED, "EVENT_CLOSE", "EVENT_RECVFROM", "EVENT_SENDTO")


#: The fields of a log line, dictated by its format. {v} stands for the version, {c} for a class, {f} for a field.
OWN_UUID = r'{v}\.{c}":\{{"uuid":"(.*?)"'
REFERENCE = r'"{f}":\{{"com.bbn.tc.schema.avro.{v}.UUID":"(.*?)"\}}'
EVENT_TYPE = '"type":"(.*?)"'
EVENT_TIME = '"timestampNanos":(.*?),'
EVENT_PATH = r'"predicateObjectPath":\{"string":"(.*?)"'
EVENT_EXEC = '.*?"exec":"(.*?)"'
COMMAND_LINE = r'"cmdLine":\{"string":"(.*?)"\}'
PLAIN_FIELD = '"{f}":"(.*?)"'
ADDRESSES = {
    "cdm18": '"localAddress":"(.*?)","localPort":(.*?),"remoteAddress":"(.*?)","remotePort":(.*?),',
    "cdm20": r'"localAddress":\{"string":"(.*?)"\},"localPort":\{"int":(.*?)\},"remoteAddress":\{"string":"(.*?)"\},"remotePort":\{"int":(.*?)\}',
}
SOCKET = r'NetFlowObject":\{"uuid":"(?:.*?)"(?:.*?)'


@dataclass(frozen=True)
class Profile:
    """How to read one family of logs.

    subject_rule: where a subject's attribute comes from: its own 'cmdLine' or 'path', 'exec' of
    considered events, or 'exec_any' of any event, which then also makes the subject.
    file_rule: where a file's comes from: 'event_first' or 'event_last' (path of considered events
    on it), 'event_any' (path of any event on it, which the file must have), or its own 'filename' or 'path'.
    missing: attributes of a subject, file and socket without one. strict: subjects and files
    whose own record has no attribute are dropped. skip_empty: an empty subject attribute counts
    as none. unnamed: file names that drop the file. long_uuids: whether subject uuids of 64
    characters are kept.
    """

    version: str
    types: tuple[str, ...] = CONSIDERED
    drop_flows: bool = True
    subject_rule: str = "cmdLine"
    file_rule: str = "event_first"
    missing: tuple[str, str, str] = ("null", "", "null")
    strict: bool = False
    skip_empty: bool = False
    unnamed: tuple[str, ...] = ()
    long_uuids: bool = True


PROFILES: dict[str, Profile] = {
    "cadets_fast": Profile("cdm18"),
    "theia_fast": Profile("cdm18", file_rule="filename"),
    "cadets_e3": Profile("cdm18", subject_rule="exec_any", file_rule="event_any", skip_empty=True, unnamed=("none",), long_uuids=False),
    "theia_e3": Profile("cdm18", file_rule="filename", strict=True, skip_empty=True, unnamed=("none",), long_uuids=False),
    "trace_e3": Profile("cdm18", CONSIDERED_WIDE, False, "cmdLine", "path", strict=True, long_uuids=False),
    "trace_e5": Profile("cdm18", CONSIDERED_WIDE, False, "cmdLine", "path", strict=True, long_uuids=False),
    "cadets_e5": Profile("cdm20", CONSIDERED_WIDE, False, "exec", "event_last", ("none", "null", "null"), long_uuids=False),
    "theia_e5": Profile("cdm20", CONSIDERED_WIDE, False, "path", "filename", strict=True, long_uuids=False),
}

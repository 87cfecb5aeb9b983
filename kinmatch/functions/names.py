"""Normalising names of library functions, as array expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes of names that work alike; the first of a class stands for it.
CLASSES = (
    (".gettext", ".dgettext", ".dcgettext"),
    (".printf", ".__printf_chk"),
    (".fprintf", ".__fprintf_chk"),
    (".snprintf", ".__snprintf_chk"),
    (".sprintf", ".__sprintf_chk"),
    (".strcpy", ".__strcpy_chk"),
    (".asprintf", ".__asprintf_chk"),
    (".toupper", ".__ctype_toupper_loc"),
    (".tolower", ".__ctype_tolower_loc"),
    (".siglongjmp", ".__longjmp_chk"),
    (".fseeko", ".fseeko64"),
    (".lseek", ".lseek64"),
    (".open", ".open64"),
    (".__libc_start_main", "__libc_start_main"),
    (".__cxa_finalize", "__cxa_finalize"),
    (".__xstat64", ".__xstat"),
    (".realpath", ".__realpath_chk"),
)
# Alternatives that do the same together; the first alternative replaces the first one found whole.
GROUPS = (((".malloc", ".memset"), (".calloc",)),)
# Names too frequent to tell functions apart. Strict adds the names that a typing slip keeps out.
STOP = (".strcmp", ".strncmp", ".getc_unlocked", ".__uflow", ".free", ".ferror_unlocked")
STRICT_STOP = (*STOP, ".bsearch", ".strcpy")

# Where the arguments of some library functions lie; None: it takes none.
X64_ARGUMENTS = {
    ".fprintf": ("rdi", "rsi"), ".__fprintf_chk": ("rdi", "rsi", "rdx"), ".printf": ("rdi", "rsi"), ".__printf_chk": ("rdi", "rsi", "rdx"), ".gettext": ("rdi",),
    ".dcgettext": ("rdi", "rsi", "rdx"), ".malloc": ("rdi",), ".fwrite": ("rdi", "rsi", "rdx", "rcx"), ".__errno_location": None, ".abort": None, ".localeconv": None,
}
X86_ARGUMENTS = {
    ".malloc": (4,), ".gettext": (4,), ".dcgettext": (4, 8, 12), ".fwrite": (4, 8, 12, 16), ".__errno_location": None, ".abort": None, ".localeconv": None, ".__assert_fail": (4, 8),
}
AARCH64_ARGUMENTS = {
    ".fprintf": ("x0", "x1"), ".__fprintf_chk": ("x0", "x1", "x2"), ".printf": ("x0", "x1"), ".__printf_chk": ("x0", "x1", "x2"), ".gettext": ("x0",),
    ".dcgettext": ("x0", "x1", "x2"), ".malloc": ("x0",), ".fwrite": ("x0", "x1", "x2", "x3"), ".__errno_location": None, ".abort": None, ".localeconv": None,
}


@dataclass(frozen=True)
class Rules:
    """What names are normalised by. ``prefix`` is put before names that lack it; empty: none."""

    classes: tuple[tuple[str, ...], ...] = CLASSES
    groups: tuple[tuple[tuple[str, ...], ...], ...] = GROUPS
    stop: tuple[str, ...] = STOP
    prefix: str = "."

    def heads(self) -> dict[str, str]:
        return {name: names[0] for names in self.classes for name in names}


LIBRARY = Rules()


def _names(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def normalised(names: Column, rules: Rules = LIBRARY) -> Column:
    """The set of normalised names.

    Each name gets the prefix and becomes the head of its class. Then groups are looked for among the raw names: the
    first alternative that is there whole gives way to the first one. Stop names go last.
    """
    prefix = F.lit(rules.prefix)
    dotted = F.transform(names, lambda n: F.when(n.startswith(rules.prefix), n).otherwise(F.concat(prefix, n))) if rules.prefix else names
    pairs = [F.lit(x) for kv in rules.heads().items() for x in kv]
    if pairs:
        heads = F.create_map(*pairs)
        dotted = F.transform(dotted, lambda n: F.coalesce(F.element_at(heads, n), n))
    out = F.array_distinct(dotted)
    for group in rules.groups:
        step = out
        for alternative in reversed(group):
            whole = F.size(F.array_except(_names(alternative), names)) == 0
            taken = F.array_union(F.array_except(out, _names(alternative)), _names(group[0]))
            step = F.when(whole, taken).otherwise(step)
        out = step
    return F.array_except(out, _names(rules.stop))


def arguments(name: Column, arch: str, default: Column) -> Column:
    """Argument places of a library function as an array of strings; default for unknown ones, empty for those without."""
    table = {"x64": X64_ARGUMENTS, "x86": X86_ARGUMENTS, "aarch64": AARCH64_ARGUMENTS}[arch]
    out = default
    for known, places in table.items():
        out = F.when(name == known, _names(tuple(map(str, places or ())))).otherwise(out)
    return out

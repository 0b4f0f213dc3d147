"""SQL of the keyword rules, spelled from the same fixed values as their Column form."""

from __future__ import annotations

from collections.abc import Iterable

from pricetide.functions import kinds


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has_pattern(text: str, patterns: Iterable[str]) -> str:
    return f"regexp_matches({text}, {quoted('|'.join(patterns))})"


def has_word(text: str, patterns: Iterable[str]) -> str:
    return has_pattern(text, [rf"\b(?:{'|'.join(patterns)})\b"])


def holds(text: str, parts: Iterable[str]) -> str:
    return "(" + (" OR ".join(f"contains({text}, {quoted(p)})" for p in parts) or "false") + ")"


def portable(title: str) -> str:
    """``kinds.is_portable``."""
    low = f"strip_accents(lower(coalesce({title}, '')))"
    parts = {k: has_word(low, p) for k, p in kinds.SIGNS.items()}
    lines = [has_word(low, p) for p in kinds.LINE_SIGNS.values()]
    n_signs = " + ".join(f"CAST({c} AS INT)" for c in (*parts.values(), *lines))
    second = f"CASE WHEN {' OR '.join(lines)} THEN NOT {has_word(low, kinds.CARD_WORDS)} ELSE {parts['storage']} END"
    return f"({has_word(low, kinds.PORTABLE_WORDS)} OR {has_word(low, kinds.PORTABLE_MODELS)} OR ({n_signs} >= 4 AND {parts['screen']} AND {parts['cpu']} AND {parts['ram']} AND {second}))"


def portable_on_page(title: str) -> str:
    """``kinds.is_portable_on_page``."""
    low = f"lower(coalesce({title}, ''))"
    sized = f"({has_pattern(low, [kinds_size])} AND NOT {holds(low, kinds.BROWSE_SCREENS)})"
    built = f"({holds(low, kinds.BROWSE_CPUS)} AND {holds(low, kinds.BROWSE_GPUS)} AND {holds(low, kinds.BROWSE_PANELS)})"
    return f"({holds(low, kinds.BROWSE_PORTABLE)} OR {sized} OR {holds(low, kinds.BROWSE_FORMS)} OR {built})"


kinds_size = r"\d{2}(\.\d)?\s*pouce"


def fits(title: str, slug: str) -> str:
    """``kinds.fits_slug``."""
    low = f"lower(coalesce({title}, ''))"
    cases = []
    for name, needed in kinds.SLUG_NEEDED.items():
        guard = "" if name in kinds.NO_PORTABLE_RULE else f" AND NOT {portable_on_page(title)}"
        cases.append(f"WHEN {slug} = '{name}' THEN {has_pattern(low, needed)} AND NOT {holds(low, kinds.SLUG_DENIED[name])}{guard}")
    return f"CASE {' '.join(cases)} ELSE true END"


def cascade(title: str) -> str:
    """``kinds.cascade``."""
    low = f"lower(coalesce({title}, ''))"
    return "CASE " + " ".join(f"WHEN {has_pattern(low, [words.replace('.', chr(92) + '.')])} THEN '{kind}'" for kind, words in kinds.CASCADE) + " ELSE 'pc_part' END"


def slug_of(title: str) -> str:
    """``kinds.slug_of``."""
    rules = " ".join(f"WHEN {has_pattern(f'lower({title})', [p])} THEN '{slug}'" for slug, p in kinds.SLUG_RULES)
    return f"CASE WHEN {portable(title)} THEN 'laptop' {rules} END"


def engine_category(title: str, url: str) -> str:
    """``kinds.engine_category``."""
    low, link = f"lower(coalesce({title}, ''))", f"lower(coalesce({url}, ''))"
    sums = []
    for i, (kind, (patterns, hint)) in enumerate(kinds.ENGINE_RULES.items()):
        hinted = "0" if hint == "(?!)" else f"CASE WHEN {has_pattern(link, [hint])} THEN 5 ELSE 0 END"
        total = " + ".join(f"CASE WHEN {has_pattern(low, [p])} THEN {w} ELSE 0 END" for p, w in patterns)
        sums.append(f"{{'s': {total} + {hinted}, 'i': {-i}, 'c': '{kind}'}}")
    best = f"list_max([{', '.join(sums)}])"
    return f"CASE WHEN {best}.s >= 3 THEN {best}.c ELSE 'unknown' END"

"""Settings of the jobs; pass a changed copy (dataclasses.replace) to change one."""

from __future__ import annotations

from dataclasses import dataclass

#: White space of the rules: ASCII, no-break, byte-order mark and the Unicode spaces.
SPACE = r"[\s\x0B\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: The same as characters.
SPACES = "\t\n\x0b\f\r \xa0\ufeff\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


@dataclass(frozen=True)
class Patterns:
    """The default line patterns of legal texts, tried in this order."""

    chapter: str = r"^\s*CAP[IÍ]TULO\s+([IVXLCDM]+|[0-9]+)[\s\-–—.]*(.*)$"
    subsection: str = r"^\s*SUBSE[ÇC][ÃA]O\s+([IVXLCDM]+|[0-9]+)[\s\-–—.]*(.*)$"
    section: str = r"^\s*SE[ÇC][ÃA]O\s+([IVXLCDM]+|[0-9]+)[\s\-–—.]*(.*)$"
    article: str = r"^\s*Art(?:igo)?\.?\s*(\d+(?:[\-–][A-Z])?)\s*[ºo°]?\s*[.\-–—]?\s*(.*)$"
    paragraph: str = r"^\s*(?:§\s*(\d+)\s*[ºo°]?|Par[áa]grafo\s+[úu]nico)\s*[.\-–—]?\s*(.*)$"
    inciso: str = r"^\s*([IVXLCDM]+)\s*[\-–—.]\s+(.*)$"
    alinea: str = r"^\s*([a-z])\s*\)\s+(.*)$"
    item: str = r"^\s*(\d+)\s*[.)]\s+(.*)$"
    note: str = r"^\s*(?:Obs\.?|Observa[çc][ãa]o|Nota)\s*[:\-–—.]?\s*(.*)$"
    amendment: str = r"(\(\s*NR\s*\)|\(\s*nova\s+reda[çc][ãa]o\s*\)|reda[çc][ãa]o\s+dada\s+pel[ao])"
    citation: str = r"((?:Lei(?:\s+(?:Complementar|Federal|Estadual|Municipal|Org[âa]nica))?|Decreto(?:-Lei)?|Medida\s+Provis[óo]ria|Emenda\s+Constitucional)\s+n\s*[ºo°.]?\s*[\d.]+(?:\s*[,/]\s*de\s+[^,;.]+)?)"


#: What the lower case of a line holds if one of these patterns fits it anywhere; a changed pattern is looked for everywhere.
CUES = {Patterns.amendment: ("(", "pel"), Patterns.citation: ("lei", "decreto", "medida", "emenda")}


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    overlap: int = 1
    #: Kept of the limit for the header's own line breaks; least limit and least budget.
    reserve: int = 8
    least_limit: int = 64
    least_budget: int = 32


@dataclass(frozen=True)
class Retrieval:
    vector_k: int = 30
    metadata_k: int = 15
    final_k: int = 8
    per_document: int = 2

"""Patterns, keywords and word lists of legal text. All of them are fixed values that results depend on."""

from __future__ import annotations

from typing import NamedTuple


class ClausePattern(NamedTuple):
    """A clause type with the regexes of its headings, the keywords of its body and the hits it needs."""

    name: str
    headings: tuple[str, ...]
    keywords: tuple[str, ...]
    hits: int = 2


# Clause types in order of priority.
CLAUSES = (
    ClausePattern("indemnification", (r"indemnif(?:y|ication|ied)", r"hold\s+harmless"), ("indemnify", "indemnification", "hold harmless", "defend", "losses", "damages", "claims", "third party", "liabilities", "costs and expenses")),
    ClausePattern("termination", (r"termination", r"term\s+and\s+termination"), ("terminate", "termination", "expiry", "expiration", "upon written notice", "days notice", "right to terminate", "material breach", "effective date of termination", "surviving provisions")),
    ClausePattern("confidentiality", (r"confidential(?:ity)?", r"non[\-\s]?disclosure", r"nda"), ("confidential", "confidentiality", "non-disclosure", "proprietary information", "trade secret", "disclose", "receiving party", "disclosing party", "confidential information")),
    ClausePattern("non_compete", (r"non[\-\s]?compete", r"non[\-\s]?competition", r"restrictive\s+covenant"), ("non-compete", "non-competition", "compete", "competitive", "restricted period", "restricted area", "competing business")),
    ClausePattern("non_solicitation", (r"non[\-\s]?solicitation",), ("non-solicitation", "solicit", "hire", "recruit", "employees", "customers", "clients", "personnel")),
    ClausePattern("governing_law", (r"governing\s+law", r"choice\s+of\s+law", r"applicable\s+law"), ("governed by", "governing law", "laws of the state", "laws of", "applicable law", "without regard to", "conflict of law", "choice of law"), 1),
    ClausePattern("jurisdiction", (r"jurisdiction", r"venue"), ("jurisdiction", "venue", "courts of", "submit to", "exclusive jurisdiction", "competent court"), 1),
    ClausePattern("force_majeure", (r"force\s+majeure",), ("force majeure", "act of god", "natural disaster", "beyond reasonable control", "epidemic", "pandemic", "war", "terrorism", "flood", "earthquake", "unforeseeable", "unavoidable")),
    ClausePattern("payment", (r"payment", r"fees?\s+and\s+payment", r"compensation", r"pricing"), ("payment", "pay", "invoice", "net 30", "net 60", "due date", "late fee", "interest", "compensation", "fee", "pricing", "amount due")),
    ClausePattern("liability", (r"limitation\s+of\s+liability", r"liability", r"cap\s+on\s+liability"), ("limitation of liability", "aggregate liability", "shall not exceed", "indirect damages", "consequential damages", "incidental damages", "special damages", "punitive damages", "in no event", "cap on liability")),
    ClausePattern("intellectual_property", (r"intellectual\s+property", r"ip\s+rights", r"ownership\s+of\s+work"), ("intellectual property", "patent", "copyright", "trademark", "trade secret", "license", "ownership", "work product", "proprietary rights", "ip rights")),
    ClausePattern("warranty", (r"warrant(?:y|ies)", r"disclaimer\s+of\s+warrant"), ("warranty", "warranties", "warrants", "as is", "merchantability", "fitness for a particular purpose", "disclaimer", "no warranty")),
    ClausePattern("representations", (r"representations?\s+and\s+warranties", r"representations"), ("represents", "representation", "warrants", "represents and warrants", "covenants", "acknowledges", "duly authorized", "validly existing", "good standing")),
    ClausePattern("dispute_resolution", (r"dispute\s+resolution", r"arbitration", r"mediation"), ("dispute", "arbitration", "mediation", "arbitrator", "dispute resolution", "good faith", "negotiate", "binding arbitration", "adr")),
    ClausePattern("assignment", (r"assignment",), ("assign", "assignment", "transfer", "delegate", "without prior written consent", "assignee", "successor")),
    ClausePattern("severability", (r"severability",), ("severability", "severable", "invalid", "unenforceable", "remaining provisions", "shall remain in full force")),
    ClausePattern("entire_agreement", (r"entire\s+agreement", r"integration", r"merger\s+clause"), ("entire agreement", "whole agreement", "supersedes", "prior agreements", "prior negotiations", "constitutes the entire", "oral or written")),
    ClausePattern("amendment", (r"amendment", r"modification"), ("amendment", "modify", "modification", "amended", "in writing", "signed by both parties", "mutual consent", "written agreement")),
    ClausePattern("notice", (r"notice", r"notices"), ("notice", "written notice", "deliver", "certified mail", "email notification", "deemed received", "sent to", "address", "attention")),
)

# What begins a section, and the months and spans of extracted entities.
HEADING = r"(?:^|\n)(?:(?:\d{1,3}[.)]\s*)|(?:[A-Z][A-Z\s]{3,}[A-Z]\.?\s*\n)|(?:(?:Section|Article|Clause)\s+\d+[.:]?\s*))"
_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
_NAME = r"(?:[A-Z][A-Za-z&,.'\- ]+(?:Ltd|LLC|Inc|Corp|LLP|GmbH|Pvt|PLC)?\.?)"


class EntityPattern(NamedTuple):
    """A regex of an entity type; `flags` are those of Java and RE2 alike: i ignores case, m makes ^ and $ match at lines.
    `begin` holds wherever a match begins; Java looks for it first, as it is cheaper, and it excludes no match. One of
    `needs` stands in the lower-cased text of every match in ASCII, so that texts without any need no search."""

    pattern: str
    flags: str = ""
    begin: str = ""
    needs: tuple[str, ...] = ()


# Fixed values. The class of currency signs holds the characters of a wrongly decoded text; it is kept as it is.
ENTITY_PATTERNS = {
    "date": (
        EntityPattern(rf"\b(?:{_MONTH})\.?\s+\d{{1,2}},?\s+\d{{4}}\b", "i", "[jfmasond][aepuco][nbrylgptvc]"),
        EntityPattern(rf"\b\d{{1,2}}\s+(?:{_MONTH})\.?\s+\d{{4}}\b", "i", r"\d", ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")),
        EntityPattern(r"\b\d{4}[-/]\d{2}[-/]\d{2}\b", begin=r"\d", needs=("-", "/")),
        EntityPattern(r"\b\d{2}/\d{2}/\d{4}\b", begin=r"\d", needs=("/",)),
    ),
    "money": (
        EntityPattern(r"(?:[$Â£â‚¬Â¥]|USD|GBP|EUR)\s*\d[\d,]*(?:\.\d{1,2})?(?:\s*(?:million|billion|thousand|hundred))?", "i", r"[$uge\x{80}-\x{10FFFF}]"),
        EntityPattern(r"\b\d[\d,]*(?:\.\d{1,2})?\s*(?:dollars?|pounds?|euros?|USD|GBP|EUR)\b", "i", r"\d", ("dollar", "pound", "usd", "gbp", "eur")),
    ),
    "party": (
        EntityPattern(rf'(?:by\s+and\s+)?between\s+({_NAME})\s*(?:\(["“]?\w+["”]?\))?\s+and\s+({_NAME})', begin="b"),
        EntityPattern(r"([A-Z][A-Za-z&,.'\- ]+(?:Ltd|LLC|Inc|Corp|LLP|GmbH|Pvt|PLC)?\.?)\s*\((?:the\s+|hereinafter\s+)?[" + '"“](\\w+)["”]' + r"\)", begin=r"[A-Z][A-Za-z&,.'\- ]*+\s*+\((?:the\s+|hereinafter\s+)?" + '["“]\\w+["”]\\)'),
    ),
    "duration": (EntityPattern(r"\b(?:\w+\s*\(\s*)?(\d+)\s*\)?\s*(days?|weeks?|months?|years?|business\s+days?)\b", "i", r"\b(?:\d|\w++\s*+\(\s*+\d)"),),
    "reference": (EntityPattern(r"\b(?:Section|Article|Clause|Paragraph|Schedule|Exhibit|Appendix|Annex)\s+[\dIVXivx]+(?:\.\d+)*(?:\([a-z]\))?", "i", "[sacpe][erlacxpn][ctarhpn]"),),
    "obligation": (EntityPattern(r"(?:shall|must|agrees?\s+to|is\s+obligated\s+to|undertakes?\s+to|covenants?\s+to|will\s+be\s+required\s+to)\s+(.{10,120}?)(?:\.|;|$)", "im", "[smaiucw][hugsnoi]"),),
}
ENTITY_CONFIDENCE = {"date": 0.9, "money": 0.95, "party": 0.8, "duration": 0.85, "reference": 0.95, "obligation": 0.7}

_NER_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)"
_SCALE = r"(?:\s*(?:million|billion|trillion|thousand|k|m|bn)\b)?"
_SUFFIX = r"(?:Corporation|Corp\.|Incorporated|Inc\.|Limited|Ltd\.?|LLC|LLP|LP|PLC|plc|GmbH|S\.A\.|N\.V\.|B\.V\.|Association|Foundation|Institute|Authority|Commission|Department|Ministry|Office|Agency|Bureau|Board|Council|Group|Holdings|Partners?|Trustees?)"
_TITLE = r"(?:Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Prof\.?|Sir|Dame|Lord|Lady|Justice|Judge|Honourable|Honorable|Hon\.?|Counsel|Barrister|Solicitor|Attorney|Advocate)"


class NamedPattern(NamedTuple):
    """A regex of a named-entity type. `before` and `after` are classes of the characters that must not precede, or one
    of which (or the end) must follow."""

    pattern: str
    confidence: float
    flags: str = ""
    before: str = ""
    after: str = ""


# Named entities, in the order of types and patterns.
NAMED_PATTERNS = {
    "DATE": (
        NamedPattern(r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", 0.95),
        NamedPattern(r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b", 0.85),
        NamedPattern(r"\b(\d{1,2})[.\-](\d{1,2})[.\-](\d{4})\b", 0.85),
        NamedPattern(rf"\b{_NER_MONTH}\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}\b", 0.98, "i"),
        NamedPattern(rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+{_NER_MONTH}\s+\d{{4}}\b", 0.98, "i"),
        NamedPattern(r"\b(?:in|of|since|until|before|after|by)\s+(\d{4})\b", 0.7, "i"),
    ),
    "MONETARY": (
        NamedPattern(r"[$£€¥₹]\s*\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?" + _SCALE, 0.97, "i", before=r"\w"),
        NamedPattern(r"(?:USD|GBP|EUR|CAD|AUD|CHF|JPY|CNY)[\s]*\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?" + _SCALE, 0.96, "i", before=r"\w"),
        NamedPattern(r"\b\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?(?:\s+(?:million|billion|trillion|thousand))?\s+(?:dollars?|pounds?\s+sterling|pounds?|euros?|sterling|cents?)\b", 0.88, "i"),
    ),
    "CITATION": (
        NamedPattern(r"\b[A-Z][A-Za-z\s&',.()-]{1,50}\s+v\.?\s+[A-Z][A-Za-z\s&',.()-]{1,50}(?:\s*[\[(]\d{4}[\])])?(?:\s+\d+\s+[A-Z][A-Za-z.]+\s+\d+)?", 0.85),
        NamedPattern(r"\[\d{4}\]\s+[A-Z]{2,6}(?:\s+[A-Za-z]+)?\s+\d+", 0.95),
        NamedPattern(r"\b\d+\s+U\.S\.C\.?\s+§+\s*\d+(?:\.\d+)*\b", 0.92),
        NamedPattern(r"\b\d+\s+(?:[A-Z][A-Za-z.]*\s+){1,3}\d+\b", 0.7),
    ),
    "STATUTE": (
        NamedPattern(r"\b(?:[A-Z][A-Za-z\s&()]{2,60})\s+Act(?:\s+of)?\s+\d{4}\b", 0.92),
        NamedPattern(r"\b\d+\s+[A-Z][A-Za-z.]+\s+§+\s*\d+(?:\.\d+)*\b", 0.9),
        NamedPattern(r"\b(?:Regulation|Directive|Order|Rule)\s+(?:\([A-Z]+\)\s+)?\d{4}/\d+\b", 0.9, "i"),
        NamedPattern(r"\b(?:[Ss]ection|[Aa]rticle|§)\s*\d+(?:\([a-zA-Z0-9]+\))*(?:\s+of\s+the\s+[A-Z][A-Za-z\s]+Act(?:\s+of)?\s+\d{4})?\b", 0.8),
    ),
    "ORGANIZATION": (NamedPattern(rf"\b(?:[A-Z][A-Za-z&',.]*(?:\s+[A-Za-z&',.]+){{0,8}})\s+{_SUFFIX}", 0.88, after=r"[^A-Za-z]"),),
    "PERSON": (NamedPattern(rf"\b{_TITLE}\s+(?:[A-Z][a-z]+\s+)*[A-Z][a-z]+(?:\s+(?:Jr\.?|Sr\.?|III?|IV))?\b", 0.9, "i"),),
}

# Phrases of the risk rules, in the order of the rules.
ESSENTIAL = ("termination", "confidentiality", "governing_law", "liability")
RECOMMENDED = ("indemnification", "force_majeure", "dispute_resolution", "severability", "notice")
LIABILITY_CAPS = ("shall not exceed", "limited to", "aggregate", "maximum", "cap")
MUTUAL = ("mutual", "each party", "both parties", "reciprocal")
AUTO_RENEWAL = (r"automatically\s+renew", r"auto[\-\s]?renew", r"shall\s+renew\s+for\s+successive", r"renewal\s+term")
UNILATERAL = r"(?:may|can)\s+terminate\s+(?:this\s+agreement\s+)?(?:at\s+any\s+time\s+)?(?:without\s+cause|for\s+convenience|for\s+any\s+reason)"
BROAD_IP = ("all intellectual property", "all rights, title, and interest", "work product shall belong", "assigns all rights", "hereby assigns")
IP_LIMITS = ("limited to", "scope of", "related to the project", "arising from", "in connection with")
NON_COMPETE_LIMITS = ("within", "mile", "radius", "geographic", "months", "years", "period of")
AMBIGUOUS = ("reasonable efforts", "best efforts", "as soon as practicable", "material adverse")
RISK_WEIGHTS = {"high": 1.0, "medium": 0.5, "low": 0.2, "info": 0.0}
CAP_NOTES = ("shall not exceed", "aggregate liability", "limited to", "maximum liability")
NOTICE_DAYS = r"(\d+)\s*(?:calendar\s+)?days?\s+(?:written\s+)?notice"
JURISDICTION = r"(?:laws? of (?:the )?(?:State of )?|governed by )([A-Z][A-Za-z\s]+)"
AUTO_RENEW_NOTE = r"auto(?:matically)?\s+renew"

# Words without meaning of their own, for terms and classification.
STOP_WORDS = tuple(
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should may might"
    " shall can must not no nor so if then than that this these those it its he she they them their his her our your we you who whom which what where"
    " when how all each every both few more most other some such any only own same too very just about above after again also because before between"
    " during into through under until up out over here there".split()
)
# The same for summaries.
SUMMARY_STOP_WORDS = tuple(
    "a an the and or but in on at to for of with by from as is was are were be been being have has had do does did will would could should may might"
    " shall this that these those its their such any all each both either neither not no nor so yet if then than there here where when which who whom"
    " whose what how also other into through during before after above below between upon under over".split()
)
# Legal jargon.
JARGON = tuple(
    "herein hereinafter hereinbefore hereinabove hereinbelow hereof hereto hereunder hereby herewith thereof therein thereto thereunder thereafter"
    " thereby therewith therefrom whereas wherefore wherein whereby notwithstanding aforementioned aforesaid foregoing forthwith indemnify"
    " indemnification indemnified liquidated stipulated adjudicated tort tortious tortfeasor plaintiff defendant appellant respondent petitioner claimant"
    " complainant estoppel laches subpoena mandamus certiorari habeas corpus prima facie jurisdiction jurisdictional adjudication pursuant preamble"
    " proviso codicil rescission rescind revocation revoke assignee assignor mortgagee mortgagor lessee lessor licensee licensor obligor obligee surety"
    " guarantor abatement acquittal adjournment affidavit allegation arbitration bailment chattel cognizable counterclaim decedent deposition easement"
    " encumbrance escrow fiduciary garnishment hereditament injunction interpleader lien malfeasance misfeasance nonfeasance novation pendente lite"
    " quorum recusal remand replevin stipulation subrogation usufruct venue waiver severability severance covenant covenants inure supersede"
    " supersedes counterpart counterparts mutatis mutandis inter alia ipso facto bona fide mala fides pro rata quantum meruit".split()
)

# Traces of scanning (pattern, replacement), and abbreviations (pattern, expansion), in order.
OCR = ((r"\|", " "), (r"\.{4,}", "..."), (r"\s+([.,;:!?])", r"\1"), (r"[ \t]{2,}", " "), (r"(\w)-\s*\n\s*(\w)", r"\1\2"))
ABBREVIATIONS = (
    (r"\bw/o\b", "without"),
    (r"\bw/\b", "with"),
    (r"\bincl\.", "including"),
    (r"\bexcl\.", "excluding"),
    (r"\bapprox\.", "approximately"),
    (r"\bet\s+al\.?\b", "et al."),
    (r"\bi\.e\.", "i.e."),
    (r"\be\.g\.", "e.g."),
    (r"\bvs\.?\b", "versus"),
    (r"\bv\.", "versus"),
    (r"\bno\.", "number"),
    (r"\bpara\.", "paragraph"),
    (r"\bsec\.", "section"),
    (r"\bart\.", "article"),
    (r"\bcl\.", "clause"),
    (r"\bsched\.", "schedule"),
    (r"\bex\.", "exhibit"),
    (r"\bapp\.", "appendix"),
    (r"\bamdt\.", "amendment"),
    (r"\baff't\b", "affidavit"),
    (r"\bdist\.", "district"),
    (r"\bct\.", "court"),
    (r"\bjudg\.", "judgment"),
)
# The ends of words after which a sentence goes on.
NOT_AFTER = (r"\b[A-Z]\.", r"\bNo\.", r"\bMr\.", r"\bMs\.", r"\bMrs\.", r"\bDr\.", r"\bJr\.", r"\bSr\.", r"\bSt\.", r"\bCo\.", r"\bInc\.", r"\bLtd\.", r"\bCorp\.", r"\bvs\.", r"\bSec\.", r"\bArt\.", r"\bPar\.", r"\bCl\.", r"\bEt\.", r"\bAl\.", r"\be\.g\.", r"\bi\.e\.", r"\d\.")
# Parts of words that make a sentence matter in a summary.
BOOST = ("indemnif", "terminat", "confidential", "liabilit", "breach", "govern", "jurisdict", "warrant", "represent", "covenant", "intellectual property", "force majeure", "arbitrat", "dispute", "payment", "compensat", "assignment", "obligat")

"""Fixed values of the agreement generator: word lists and template shapes. They must equal the published ones, as the
sentences and vocabularies that follow from them are compared word by word."""

from __future__ import annotations

# One list a grammar slot, in drawing order.
SLOTS: dict[str, list[str]] = {
    "subject_singular": ["dog", "boy", "teacher", "author", "pilot", "chef", "scientist", "musician", "student", "reporter", "robot", "bird", "judge", "nurse", "driver", "writer", "dancer", "guard", "actor", "manager"],
    "subject_plural": ["dogs", "boys", "teachers", "authors", "pilots", "chefs", "scientists", "musicians", "students", "reporters", "robots", "birds", "judges", "nurses", "drivers", "writers", "dancers", "guards", "actors", "managers"],
    "person_singular": ["boy", "teacher", "author", "pilot", "chef", "scientist", "musician", "student", "reporter", "judge", "nurse", "driver", "writer", "dancer", "guard", "actor", "manager"],
    "attractor_singular": ["car", "cabinet", "book", "student", "key", "report", "painting", "computer", "garden", "instrument", "map", "letter"],
    "attractor_plural": ["cars", "cabinets", "books", "students", "keys", "reports", "paintings", "computers", "gardens", "instruments", "maps", "letters"],
    "object_singular": ["girl", "doctor", "artist", "farmer", "neighbor", "coach", "editor", "mechanic", "librarian", "visitor", "lawyer", "singer", "clerk", "broker"],
    "object_plural": ["girls", "doctors", "artists", "farmers", "neighbors", "coaches", "editors", "mechanics", "librarians", "visitors", "lawyers", "singers", "clerks", "brokers"],
    "embedded_verb_singular": ["likes", "knows", "helps", "sees", "calls", "follows", "admires", "teaches", "remembers", "guides", "questions", "supports", "observes", "trusts"],
    "embedded_verb_plural": ["like", "know", "help", "see", "call", "follow", "admire", "teach", "remember", "guide", "question", "support", "observe", "trust"],
}
VERBS_SINGULAR = ["runs", "smiles", "arrives", "waits", "sleeps", "laughs", "speaks", "listens", "works", "dances", "travels", "returns", "studies", "notices", "answers", "opens", "closes", "moves", "reads", "writes"]
VERBS_PLURAL = ["run", "smile", "arrive", "wait", "sleep", "laugh", "speak", "listen", "work", "dance", "travel", "return", "study", "notice", "answer", "open", "close", "move", "read", "write"]
PREPOSITIONS = ["near", "behind", "beside", "with"]
PRONOUNS = ["that", "who"]

# Fixed values: (template type, subtype, sentence without its final verb, number of the subject, distance, attractors, depth)
_SIMPLE = [
    ("simple_agreement", "simple_singular", "The {subject_singular}", "singular", 1, 0, 0),
    ("simple_agreement", "simple_plural", "The {subject_plural}", "plural", 1, 0, 0),
]
_PP = [
    shape
    for p in PREPOSITIONS
    for shape in (
        ("pp_attractor", f"pp_plural_attractor_{p}", f"The {{subject_singular}} {p} the {{attractor_plural}}", "singular", 4, 1, 0),
        ("pp_attractor", f"pp_singular_attractor_{p}", f"The {{subject_plural}} {p} the {{attractor_singular}}", "plural", 4, 1, 0),
    )
]
_RELATIVE = [
    ("relative_clause", "object_relative_clause_that", "The {subject_singular} that the {object_singular} {embedded_verb_singular}", "singular", 5, 0, 1),
    ("relative_clause", "object_relative_clause_who", "The {person_singular} who the {object_singular} {embedded_verb_singular}", "singular", 5, 0, 1),
    ("relative_clause", "plural_object_relative_clause_that", "The {subject_plural} that the {object_singular} {embedded_verb_singular}", "plural", 5, 0, 1),
    ("relative_clause", "object_relative_clause_plural_embedded_that", "The {subject_singular} that the {object_plural} {embedded_verb_plural}", "singular", 5, 1, 1),
    ("relative_clause", "object_relative_clause_plural_embedded_who", "The {person_singular} who the {object_plural} {embedded_verb_plural}", "singular", 5, 1, 1),
]
#: The families dealt out in turn.
TEMPLATES = [family[i] for i in range(max(map(len, (_SIMPLE, _PP, _RELATIVE)))) for family in (_SIMPLE, _PP, _RELATIVE) if i < len(family)]
TEMPLATE_FIELDS = ("template_type", "subtype", "shape", "subject_number", "dependency_distance", "attractor_count", "clause_depth")

NOUN_SLOTS = [s for s in SLOTS if not s.startswith("embedded")]
NOUNS = sorted({w for s in NOUN_SLOTS for w in SLOTS[s]})
VERBS = sorted({*VERBS_SINGULAR, *VERBS_PLURAL, *SLOTS["embedded_verb_singular"], *SLOTS["embedded_verb_plural"]})
#: Metadata that a template type allows.
ALLOWED_METADATA = {
    "simple_agreement": {"dependency_distance": [1], "attractor_count": [0], "clause_depth": [0]},
    "pp_attractor": {"dependency_distance": [4], "attractor_count": [1], "clause_depth": [0]},
    "relative_clause": {"dependency_distance": [5], "attractor_count": [0, 1], "clause_depth": [1]},
}

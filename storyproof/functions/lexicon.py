"""Word lists and patterns that results depend on."""

# Words left out of keywords and counted when a short clause is judged.
STOPWORDS = """
a an and are as at be been but by can could did do does doing down during each few for from further
had has have having he her here hers herself him himself his how i if in into is it its itself
just me more most my myself no nor not of off on once only or other our ours ourselves out over own
same she should so some such than that the their theirs them themselves then there these they this
those through to too under until up very was we were what when where which while who why will with
you your yours yourself yourselves
""".split()

# Capitalised words that are no entities.
NOT_ENTITIES = """
The A An And But Or Nor For So Yet He She I We You They His Her Their Our Your
This That These Those Chapter CHAPTER Book BOOK
""".split()

# Negations left out of anchors.
NEGATIONS = "not never no none neither nor without n't".split()

# Words left out of token sets that are compared, and words that negate a statement there.
SET_STOPWORDS = """
the a an and or but if then so to of in on at by for with as
is are was were be been being do does did done have has had
this that these those it its he she they them his her their
i you we us my your our me him hers theirs
""".split()
SET_NEGATIONS = "no not never none nobody nothing neither nor without cannot can't won't doesn't didn't isn't aren't wasn't weren't".split()

# What marks a clause as a fact worth keeping however short it is.
FACT_WORDS = r"born|died|dead|killed|executed|passed\s+away|married|wife|husband|betrothed|engaged|called|known\s+as|named|son\s+of|daughter\s+of|child\s+of|father\s+of|mother\s+of|parent\s+of|brother\s+of|sister\s+of"
CLAUSE_WORDS = ("and", "but", "while", "because", "so", "however")

# Titles of aliases: with and without a full stop, and as they stand.
DOTTED_TITLES = "Mr Mrs Ms Miss Dr Sir Madam Captain Count Lord Lady".split()
PLAIN_TITLES = "Monsieur Madame Mademoiselle M. Mme. Mlle. Comte Abbé Abbe".split()
# Titles of weighted aliases.
GRAPH_TITLES = "mr mr. mrs mrs. ms ms. miss count captain doctor dr dr. sir madam monsieur mademoiselle".split()
ALIAS_WEIGHTS = {"full": 1.0, "first_last": 0.85, "first": 0.55, "last": 0.65, "title_last": 0.4, "title_full": 0.25}

# Relations whose object is a person, and those with one object at most.
PERSON_RELATIONS = ("MarriedTo", "ParentOf", "SiblingOf")
UNIQUE_RELATIONS = ("BornIn", "BornYear")
LABELS = ("SUPPORT", "NEUTRAL", "CONTRADICT")
BUCKETS = ("EARLY", "MID", "LATE")
GROUNDED = (("Claim", "nli_contradiction", "HARD"), ("Claim", "near_duplicate", "SOFT"), ("BornIn", "unique_object", "HARD"), ("BornYear", "unique_object", "HARD"), ("MarriedTo", "unique_spouse", "SOFT"))

"""Word lists used by the cleaners and the style report.

Every list is a default of a parameter: pass your own words to replace it.
"""

# English stop words of the default cleaner. Entries with an
# apostrophe cannot match once punctuation has become spaces.
ENGLISH_STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves
    he him his himself she she's her hers herself it it's its itself they them their theirs themselves
    what which who whom this that that'll these those am is are was were be been being have has had having
    do does did doing a an the and but if or because as until while of at by for with about against between
    into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only
    own same so than too very s t can will just don don't should should've now d ll m o re ve y ain
    aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't
    ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't
    won won't wouldn wouldn't
    """.split()
)

# Stop words of the custom cleaner. It keeps she, her, not and
# the modal verbs, which carry signal for the classes, and drops the HTML br.
CUSTOM_STOPWORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours
    yourself yourselves he him his himself it its itself they them their theirs themselves
    what which who whom this that these those am is
    was were be been being have has had having do does
    did doing a an the and but if or because as until
    while of at by for with about against between into
    through during before after above below from up down
    in out on off over under again further then once here
    there when where why how any both each few more
    most other some such only own same so
    than too very s will just don now br
    """.split()
)

STYLE_LEXICON = {
    "pronoun": tuple(
        """
        i me my mine myself we us our ours ourselves you your yours yourself yourselves he him his himself
        she her hers herself it its itself they them their theirs themselves
        """.split()
    ),
    "modal": tuple("can could may might must shall should will would ought cannot".split()),
    "adjective": tuple(
        """
        good bad big small old new young great little long short high low right wrong different same early late
        important public able real best better worse worst free true false full sure clear strong weak easy hard
        """.split()
    ),
    "offensive": tuple(
        "stupid idiot moron loser trash scum clown pathetic disgusting worthless dumb ugly hate shut fool".split()
    ),
}


def matchable(words):
    """The words of a list that can equal a punctuation-free token."""
    return tuple(w for w in words if "'" not in w)

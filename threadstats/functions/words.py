"""Word lists of the text operators."""

# The public Snowball list of English stop words.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was "
    "were be been being have has had having do does did doing would should "
    "could ought i'm you're he's she's it's we're they're i've you've we've "
    "they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll "
    "they'll isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't "
    "didn't won't wouldn't shan't shouldn't can't cannot couldn't mustn't let's "
    "that's who's what's here's there's when's where's why's how's a an the and "
    "but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off "
    "over under again further then once here there when where why how all any "
    "both each few more most other some such no nor not only own same so than "
    "too very"
).split()

# Words removed besides the stop words, contractions first.
CORPUS_STOP_WORDS = (
    "ill youll theyll hell shell ive youve hes shes weve youv theyve will wont "
    "wouldnt couldnt arent didnt wasnt isnt dont theyr theyv etc amp also gonna "
    "ing whether if unless yes no or just one can like get now"
).split()

# Words of the topic itself, removed from pooled texts only.
TOPIC_STOP_WORDS = (
    "voter voted vote brexit people want think know say even time year still "
    "thing let"
).split()

# A word never counted among the leading words.
NEVER_LEADING = "dont"

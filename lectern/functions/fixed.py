"""Fixed values.

The texts below are part of the data formats: records, contexts and status
lines must carry exactly these words. Prompts that only steer a model live in
``prompts.py`` and are free to change.
"""

# Whitespace removed at both ends of a text (every character Unicode calls white space,
# and the four ASCII separators).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Corpora and roles.
CORPORA = ("eli5", "sciq", "openbookqa", "wikihow")
ROLES = ("system", "user", "assistant")

# Text at the head of every chat record.
SYSTEM_TEXT = (
    "You are an expert educational tutor specializing in explaining complex concepts to "
    "undergraduate students. Provide clear, accurate, and engaging explanations using "
    "analogies, examples, and step-by-step reasoning when appropriate."
)

# User turn of a chat record, by corpus.
USER_TURNS = {
    "eli5": (
        "Question: {question}\n\nContext: {context}\n\n"
        "Provide a clear, detailed explanation suitable for someone learning this topic."
    ),
    "sciq": (
        "Science Question: {question}\n\nSupporting information: {support}\n\n"
        "Explain the answer clearly."
    ),
    "openbookqa": (
        "Question: {question}\n\nRelevant fact: {fact}\n\n"
        "Provide a clear explanation of the correct answer."
    ),
    "wikihow": "Question: {question}\n\nProvide a step-by-step explanation.",
}
OTHER_USER_TURN = "Question: {question}"

# Requests appended to user turns.
ANALOGY_REQUEST = "\n\nInclude a helpful analogy to make the concept easier to understand."
EXAMPLES_REQUEST = "\n\nProvide concrete examples to illustrate the concept."
STEPS_REQUEST = "\n\nBreak down the explanation into clear, numbered steps."

# Articles.
ARTICLE_QUESTION = "Explain how to "
ARTICLE_TITLE = "How to do it"

# Violations of a chat record, in the order they are checked.
NO_MESSAGES = "missing messages list"
BAD_ROLE = "invalid role present"
NO_CONTENT = "empty content present"
NO_USER = "missing user message"
NO_ASSISTANT = "missing assistant message"
VIOLATIONS = (NO_MESSAGES, BAD_ROLE, NO_CONTENT, NO_USER, NO_ASSISTANT)

# Slide context, topics and captions.
MAX_SLIDES = 5
TOPIC_WHEN_BLANK = "Concept from presentation"
CONCEPT_WHEN_BLANK = "Concept"
NO_CAPTION = "[Image description unavailable]"
NO_SLIDES_ERROR = "No slides found in slides_data"

# Slide card.
NO_SLIDE_CARD = "No slide data available"
NO_TEXT = "(no text)"
NO_NOTES = "(no notes)"

# Quiz.
QUIZ_KEYS = ("question", "options", "correct_index", "rationale")
QUIZ_FENCE = "```json"
QUIZ_NOT_A_LIST = "Failed to parse questions JSON"
QUIZ_BAD_ITEM = "Invalid question structure"

# Explanation styles.
STYLES = ("comprehensive", "eli5", "step_by_step", "feynman")

# Session log.
UPLOAD_FIRST = "Please upload a PPT first."
EXPLAIN_FIRST = "No previous explanation found. Click 'Explain Concept' first."
ACTION_LABELS = {
    "explain": "Explain",
    "analogy": "Generate Analogies",
    "example": "Create Examples",
    "quiz": "Generate Quiz",
}

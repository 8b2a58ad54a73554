"""Default prompts for text generation.

Only the placeholders matter to the operators; callers may pass other wording.
"""

EXPLANATION = (
    "Topic: {topic}\n\nSlides:\n{text}\n\n"
    "Explain the topic above to a first-year student. Open with the core idea in plain "
    "words, name its parts and how they work together, compare it with something "
    "familiar, work through one concrete case, and end with a mistake people often make. "
    "Write three to five paragraphs.\n"
)
ANALOGY = (
    "Topic: {topic}\n\nText:\n{text}\n\n"
    "Write two or three analogies for this topic. Take each from daily life, say which "
    "part stands for what, and say where the comparison stops being true.\n"
)
EXAMPLE = (
    "Topic: {topic}\n\nText:\n{text}\n\n"
    "Write two or three real examples of this topic. Give the situation, show the topic "
    "at work in it, and close with the lesson.\n"
)
STEPS = (
    "Topic: {topic}\n\nText:\n{text}\n\n"
    "Explain this topic as a numbered list of three to seven steps, each with a short "
    "reason, then say in one paragraph how the steps fit together.\n"
)
QUIZ = (
    "Topic: {topic}\n\nText:\n{text}\n\n"
    "Write {num_questions} multiple-choice questions on this text, each with four options "
    "of which one is right. Answer with a JSON list in a json code block; every item has "
    'the keys "question", "options", "correct_index" (counted from 0) and "rationale".\n'
)

KINDS = {
    "explanation": EXPLANATION,
    "analogy": ANALOGY,
    "example": EXAMPLE,
    "step_by_step": STEPS,
    "quiz": QUIZ,
}

STYLE_NOTES = {
    "eli5": "\n\nUse only words a young child knows.",
    "feynman": "\n\nTeach it simply, point out what is still unclear, then teach it again better.",
}

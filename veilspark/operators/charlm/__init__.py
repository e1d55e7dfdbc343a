"""Character language models: vocabularies, windows, a small transformer trained by group, evaluation and generation."""

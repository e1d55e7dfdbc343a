"""DataFrame operators: redaction, pseudonyms, risk, manifests, character language models."""

"""Training-data operators: search, mixing, media, token files, language, secrets, personal data,
near-duplicates, language-model scores and SentencePiece encoding. Nothing else imports this."""

"""Operations that prepare training data: classifiers, mixing, deduplication and packing of documents."""

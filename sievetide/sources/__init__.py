"""Where rows come from: folders, files, mail, chats, images, archives, and the given tables seen as a review's."""
